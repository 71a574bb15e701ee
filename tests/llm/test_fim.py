"""Fill-in-middle: ropes against strings, the operator against a plain version, exact round trips."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm import SF, awkward, table

from oracle import compare
from vellum.llm import fim, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.text(alphabet="ab é\t\n\u2003😀", max_size=400)


def depth(r):
    return 0 if r.left is None else 1 + max(depth(r.left), depth(r.right))


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_a_rope_is_its_text(text):
    r = fim.rope(text)
    units = UNIT.findall(text)
    assert str(r) == text and r.chars == len(text) and r.units == len(units)
    for rank in (0, 1, len(units) // 2, len(units), len(units) + 3):
        a, b = fim.split(r, rank)
        assert str(a) == "".join(units[:rank]) and str(b) == "".join(units[rank:])
        assert a.units == min(rank, len(units))
    for rank in (0, 1, len(text) // 3, len(text)):
        a, b = fim.split(r, rank, "chars")
        assert (str(a), str(b)) == (text[:rank], text[rank:])


def test_ropes_stay_flat_when_cut_and_joined():
    rng, text = random.Random(3), " ".join(f"w{k}" for k in range(40_000))
    r = fim.rope(text)
    for _ in range(300):
        a, b = fim.split(r, rng.randrange(r.chars + 1), "chars")
        r, text = fim.join(b, a), str(b) + str(a)
        assert r.height == depth(r) <= 2 * (40_000 // fim.LEAF_UNITS + 600).bit_length()
    assert str(r) == text


def plain(doc_id, text):
    text = text or ""
    units, d = UNIT.findall(text), hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<P>|<S>|<M>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_the_operator_against_a_plain_version(spark):
    rows = [(k, t) for k in range(60) for t in ("one two  three\n", f"say <M> {k}", "   ", "x", "é\u00a0ü 😀 z " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(awkward(spark).select("doc_id", "text"))
    own = docs.collect()
    out = fim.restored(fim.fill_in_middle(docs)).collect()
    assert len(out) == len(own)
    key = lambda x: (str(x[0]), x[1:])
    made = sorted(((r.doc_id, r.restored.decode(), r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output.decode()) for r in out), key=key)
    want = sorted(((r.doc_id, r.text or "", *(x or 0 if k in (2, 3) else x for k, x in enumerate(plain(r.doc_id, r.text)))) for r in own), key=key)
    assert made == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_bytes_that_are_no_text_survive(spark):
    docs = spark.sql("SELECT id AS doc_id, cast(unhex('61FF20C328206263') AS string) AS text FROM range(40)")
    out = fim.restored(fim.fill_in_middle(docs)).collect()
    assert {bytes(r.restored).hex() for r in out} == {"61ff20c328206263"} and len({r.form for r in out}) == 3


def test_awkward_tables(spark):
    assert fim.digests(awkward(spark)).count() == 10
    assert fim.digests(awkward(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.restored(fim.fill_in_middle(awkward(spark)).withColumnRenamed("n", "restored"))


def test_the_query_against_its_sql(spark):
    assert compare(queries.op13_fill_in_middle(spark, SF), fim.oracle_sql(), SF) == table(spark, "documents").count()
