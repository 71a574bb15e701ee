"""Hash trees: the traversal against whole trees, the manifest against a plain version."""

import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F
from test_llm import SF, awkward, table

from oracle import compare
from vellum.llm import merkle, queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(leaves):
    """All levels, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[k : k + 3])) for k in range(0, len(now), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append("".join(level[run:i]) + "*" + "".join(level[i + 1 : run + 3]))
        i //= 3
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 242, 729])
def test_the_traversal_against_whole_trees(n):
    leaves = [sha(str(k)) for k in range(n)]
    levels = tree(leaves)
    for i, path in enumerate(merkle.paths(leaves, merkle.height(n))):
        assert path == plain_path(levels, i)
    assert merkle.fold(leaves, merkle.height(n)) == levels[-1][0]


def test_the_traversal_keeps_two_subtrees_a_band(monkeypatch):
    alive = []
    grown = merkle.Subtree.step

    def step(self):
        grown(self)
        alive.append(sum(map(len, self.rows)) + sum(map(len, self.open)))

    monkeypatch.setattr(merkle.Subtree, "step", step)
    for _ in merkle.paths([sha(str(k)) for k in range(729)], 6):
        pass
    assert max(alive) <= 9 + 3 + 6 * 3  # a band of two levels, and the nodes that wait for their parent


def shown(row, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def plain(rows):
    """The contract's columns by whole trees in memory."""
    by: dict = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in names:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, shown(r, r.text)))
        trees[s] = tree([shown(r, r.text) for r in by[s]])
    top = tree([trees[s][-1][0] for s in names])
    for j, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = plain_path(trees[s], i) + plain_path(top, j)
            hit = r.doc_id is not None and crc32(str(r.doc_id).encode()) % 2 == 0
            node = shown(r, r.text.replace("\n", "") if hit and r.text is not None else r.text)
            for run in path:
                node = sha(run.replace("*", node))
            out.append((r.doc_id, shown(r, r.text), trees[s][-1][0], top[-1][0], sha("".join(path).replace("*", "")), node, node == top[-1][0]))
    return sorted(out, key=repr)


def held(df):
    return sorted(map(tuple, df.collect()), key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_uneven_sources_and_awkward_rows(spark):
    rng = random.Random(5)
    sizes = {"big": 300, None: 10, "é": 9, "z": 1, "": 2, "ab": 28, "a": 82}
    rows = [(k, rng.choice([None, "", "a\nb", "x y", "\n"]), rng.choice([None, "en"]), s, rng.choice([None, 3])) for s, n in sizes.items() for k in range(n)]
    rows += [(None, "t", "en", "z", 1), (5, "same", None, "ab", None), (5, "same", None, "ab", None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = merkle.checked(docs, levels=2)  # several rounds on few rows
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert held(out) == plain(docs.collect())


def test_one_round_and_many_sources(spark):
    rows = [(k, f"t{k}\n", "en", f"s{k % 37:02}" if k % 5 else "hot", k) for k in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert held(merkle.checked(docs)) == plain(docs.collect())


def test_clashing_names_and_empty_tables(spark):
    docs = awkward(spark)
    for c in ("source", "lang", "tree", "pos", "node", "own", "order", "nth", "proof"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs = docs.withColumn("n_chars", F.lit(1))
    assert merkle.checked(docs).count() == 10
    assert merkle.checked(docs.limit(0)).count() == 0
    kept = merkle.manifest(docs, fields=("doc_id", "text"), tree_col="lang", size=F.length("text")).collect()
    assert len(kept) == 10 and {r.size for r in kept if r.leaf == kept[0].leaf}


def test_the_query_against_its_sql(spark):
    assert compare(queries.op11_merkle_manifest(spark, SF), merkle.oracle_sql(), SF) == table(spark, "documents").count()
