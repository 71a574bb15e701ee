"""The best user turn of whole assistant turns, against the standard library's matcher."""

from difflib import SequenceMatcher

from vellum.catalog import QUERIES


def test_whole_turns_against_brute_force(spark, tmp_path):
    rows = [
        (1, 0, "user", "yes of course"), (1, 1, "assistant", "yes\nthe contract ends in May\nand is renewed each year"),
        (1, 2, "user", "the contract ends in May and is renewed"), (1, 3, "assistant", "no"), (1, 4, "assistant", "\nsecond line of course"),
        (2, 0, "assistant", "nobody asked"), (3, 0, "user", None), (3, 1, "assistant", None), (3, 2, "assistant", "a\nb"), (3, 3, "user", "a\nb"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = set()
    for c, t, role, text in rows:
        users = [(n, x or "") for d, n, r, x in rows if d == c and r == "user"]
        if role == "assistant" and users:
            score = lambda x: sum(m.size for m in SequenceMatcher(None, text, x, autojunk=False).get_matching_blocks()) / len(text) if text else 1.0  # noqa: E731, B023
            best = min(users, key=lambda u: (-round(score(u[1]), 6), u[0]))
            want.add((c, t, best[0], round(score(best[1]), 6)))
    got = {(r.conv_id, r.turn, r.best, r.score) for r in QUERIES["containment_best_match"](spark, str(tmp_path)).collect()}
    assert got == want and (1, 1, 2) in {x[:3] for x in got}


def test_difflib_similarity_against_the_library(spark):
    from difflib import SequenceMatcher

    from vellum.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.text))
    want = {}
    for conv, own in turns.items():
        own.sort()
        for (_, a), (k, b) in zip(own, own[1:], strict=False):
            if a is not None:
                want[conv, k] = round(SequenceMatcher(None, a, b or "").ratio(), 6)
    got = {(r.conv_id, r.turn): r.ratio for r in QUERIES["difflib_similarity"](spark, sf).collect()}
    assert got == want and want


def test_nearest_join_and_overlaps(spark):
    import random

    from vellum.operators import ordered as O

    rng = random.Random(6)
    left = [(rng.randrange(3), float(rng.randrange(12)), k) for k in range(40)]
    right = [(rng.randrange(2), float(rng.randrange(12)), k) for k in range(30)]
    kind = "g int, at double, {} long"
    got = {r.l: r.r for r in O.nearest_join(spark.createDataFrame(left, kind.format("l")), spark.createDataFrame(right, kind.format("r")), ["g"], "at", "l", "r").collect()}
    want = {k: min(((abs(a - b), i) for h, b, i in right if h == g), default=(0, None))[1] for g, a, k in left}
    assert got == {k: v for k, v in want.items() if v is not None}
    a = [(rng.randrange(2), k, s, s + rng.randrange(0, 30)) for k in range(30) for s in [rng.randrange(-20, 60)]]
    b = [(rng.randrange(2), k, s, s + rng.randrange(0, 30)) for k in range(30) for s in [rng.randrange(-20, 60)]]
    for width in (1, 7, 100):
        out = O.best_overlap(spark.createDataFrame(a, "g int, l int, l_start int, l_stop int"), spark.createDataFrame(b, "g int, r int, r_start int, r_stop int"), ["g"], "l", "r", width)
        best = {}
        for g, k, s, e in a:
            hits = [(-(min(e, f) - max(s, t)), i) for h, i, t, f in b if h == g and s < f and t < e and s < e and t < f]
            if hits:
                best[k] = min(hits)[1]
        assert {r.l: r.r for r in out.collect()} == best
