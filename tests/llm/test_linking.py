import random

from textloom.llm.linking import connected_components, joined_components, link_buckets


def groups(edges):
    root = {}

    def of(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = of(a), of(b)
        root[max(x, y)] = min(x, y)
    return {x: of(x) for x in list(root)}


def test_small_buckets_are_compared_whole(spark):
    """Of buckets with no more members than leaders nothing is left after the second round, larger ones go on; the groups are
    those of all pairs."""
    r = random.Random(3)
    rows = [(b, i) for b in range(12) for i in r.sample(range(400), 30 if b < 2 else r.randint(2, 8))]
    linked = lambda a, b: (a * 7 + b * 7) % 5 == 0 or abs(a - b) < 9
    calls = []

    def confirm(pairs):
        got = [(x.a, x.b) for x in pairs.collect()]
        assert len(set(got)) == len(got) and all(a < b for a, b in got)
        calls.append(got)
        return spark.createDataFrame([x for x in got if linked(*x)], "a long, b long")

    every = {(min(x, y), max(x, y)) for b, x in rows for c, y in rows if b == c and x != y}
    small = [x for x in rows if x[0] >= 2]
    for members, rounds in ((rows, None), (small, 2)):
        calls.clear()
        got = dict(map(tuple, link_buckets(spark.createDataFrame(members, "bucket long, id long"), confirm, leaders=8, whole=True).collect()))
        own = {(min(x, y), max(x, y)) for b, x in members for c, y in members if b == c and x != y}
        assert got == groups(x for x in own & every if linked(*x))
        assert rounds is None or len(calls) == rounds


def test_edges_join_groups_that_were_there(spark):
    r = random.Random(4)
    old = [(r.randrange(60), r.randrange(60)) for _ in range(30)]
    new = [(r.randrange(90), r.randrange(90)) for _ in range(12)]
    edges = lambda e: spark.createDataFrame([x for x in e if x[0] != x[1]], "a long, b long")
    for first, more in ((old, new), ([], new), (old, [])):
        got = joined_components(connected_components(edges(first)), edges(more))
        assert dict(map(tuple, got.collect())) == groups(x for x in [*first, *more] if x[0] != x[1])
