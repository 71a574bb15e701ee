"""Resharding with one text that holds most bytes: only its rows are dealt, groups of equal texts in its block stay whole."""

from test_llm import docs_of

from vellum.llm import reshard


def test_groups_beside_a_hot_text_stay_whole(spark):
    texts = ["hot " * 50] * 400 + [f"text number {k}" for k in range(40) for _ in range(12)]
    docs = docs_of(spark, texts)
    for blocks in (1, 4, 4096):  # with few blocks, the groups share the hot text's
        rows = reshard.reshard(docs, shards=8, blocks=blocks).collect()
        shards, slots = {}, {}
        for r in rows:
            shards.setdefault(texts[r.doc_id - 1], set()).add(r.shard)
            slots.setdefault(r.shard, []).append(r.slot)
        assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len(shards.pop(texts[0])) > 1 and all(len(s) == 1 for s in shards.values())
