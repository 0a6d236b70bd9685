import random
import re

from helpers import ODD, frame, low, words

from textloom.llm import near_dedup as N
from textloom.llm.linking import connected_components, link_buckets
from textloom.llm.near_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted((str(d), len(sets[i]), str(least[root(i)])) for i, (d, _) in enumerate(rows))


def family(seed, n):
    r, vocabulary = random.Random(seed), words(seed)
    base = [r.choice(vocabulary) for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    return out


def test_equals_brute_force(spark):
    texts = [*family(1, 60), *family(2, 30), *[" ".join(random.Random(i).choices(words(9), k=50)) for i in range(40)]]
    texts += [texts[0].upper(), texts[3] + " \n", texts[3]]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts, 20)] + ODD
    got = near_duplicates(frame(spark, rows), 3, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)


def test_default_is_five_words_at_eighty(spark):
    rows = list(enumerate(family(3, 80)))
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 5, 80)


def test_links_left_to_the_prefix_join(spark, monkeypatch):
    """A large group around a text that is missing, just below and above the similarity: the second round has two leaders
    a bucket, so that most links are the last step's; its pairs hold no more than a small share of all pairs."""
    r, vocabulary = random.Random(6), words(6, 3000)
    base, rows = [r.choice(vocabulary) for _ in range(150)], []
    for i in range(260):
        w = list(base)
        for _ in range(r.randint(3, 7)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for i in range(40):
        w = rows[i][1].split()
        w[r.randrange(len(w))] = "zz"
        rows.append((1000 + i, " ".join(w)))
    last, found = N.pairs_near_leads, []

    def counted(apart, similarity):
        pairs = last(apart, similarity)
        found.append(pairs.count())
        return pairs

    monkeypatch.setattr(N, "pairs_near_leads", counted)
    monkeypatch.setattr(N, "link_buckets", lambda *a, **b: link_buckets(*a, **b, leaders=2))
    got = near_duplicates(frame(spark, rows), 3, 85).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows, 3, 85)
    assert found and found[0] < 2000


def test_elements_of_one_group_leave_the_prefix_join(spark, monkeypatch):
    """What only one group has is placed nowhere; the links between groups are found all the same."""
    texts = {1: set(range(100)), 2: {*range(2, 100), 200, 201}}
    texts |= {10 + i: {*range(30), *range(300, 370), 500 + i} for i in range(40)}
    texts[90] = {*range(30), *range(300, 369), 600, 601}
    root = {i: 10 if 10 <= i < 50 else i for i in texts}
    rows = [(1, 1, i, root[i], len(s), 100, sorted(s ^ texts[1])) for i, s in texts.items() if i != 1]
    placed, kept = [], N.stored
    monkeypatch.setattr(N, "stored", lambda df: placed.append(kept(df)) or placed[-1])
    apart = spark.createDataFrame(rows, "lead long, lead_root long, id long, root long, n long, lead_n long, apart array<long>")
    got = set(map(tuple, N.pairs_near_leads(apart, 85).collect()))
    sets = {(a, b) for a in texts for b in texts if a < b and root[a] != root[b] and 100 * len(texts[a] & texts[b]) >= 85 * len(texts[a] | texts[b])}
    assert sets <= got and (10, 90) in sets and (1, 2) in sets
    assert all(r.e < 500 or r.e >= 600 for r in placed[0].collect())
    alone = apart.where("root = 10")
    assert N.pairs_near_leads(alone, 85).count() == 0 and placed[1].count() == 0


def test_very_long_texts(spark):
    r = random.Random(3)
    long = r.choices(words(3), k=60_000)
    near, far = [*long[:1000], "zz", *long[1001:]], r.choices(words(4), k=60_000)
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(long[:55_000]))]
    got = near_duplicates(frame(spark, rows), 3, 85).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(rows, 3, 85)


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (None, 5), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100}
