"""Ball-hashed SimHash join, hard negatives from shared lists, stratified search: against plain versions."""
import math
import random
import re

import brute
import numpy as np
import pytest
import xxhash
from odd_rows import ODD
from turnwise.llm import lexical, negatives, simhash
from turnwise.llm.components import components

SF = "/root/testdata/sf0.001"


def key(rows):
    return sorted(rows, key=str)


# 11 SimHash

def fingerprint(text):
    w = brute.WORD.findall(brute.lower(text))
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, ids):
    """{id of row: least id reachable}; links between fingerprints with at most 4 differing bits."""
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for i, row in enumerate(ids):
        if row is not None:
            least[find(i)] = min(least.get(find(i), row), row)
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark, frame):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1000 + (r[0] or 0) if r[0] is not None else None, r[1]) for r in ODD if len(r[1] or "") < 200_000]
    prints = [fingerprint(t) for _, t in rows]
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, groups(prints, [i for i, _ in rows]))]
    assert key(tuple(r) for r in simhash.join(frame(rows)).collect()) == key(want)


def test_simhash_of_odd_and_no_rows(odd, empty):
    got = simhash.join(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert simhash.join(empty).collect() == []


def test_pieces_and_loads_change_no_fingerprint(monkeypatch):
    texts = [None, "", "a b c", "x " * 700, *[" ".join(random.Random(i).choices(["ab", "cde", "f", "é"], k=90)) for i in range(30)]]
    want = [fingerprint(t) for t in texts]
    assert simhash.fingerprints_of(texts).tolist() == want
    monkeypatch.setattr(simhash, "PIECE", 17)
    monkeypatch.setattr(simhash, "LOAD", 40)
    assert simhash.fingerprints_of(texts).tolist() == want


@pytest.mark.parametrize("spelled", [1 << 22, 2000])
def test_every_pair_within_the_radius_is_connected(spark, monkeypatch, spelled):
    monkeypatch.setattr(simhash, "SPELLED", spelled)
    monkeypatch.setattr(simhash, "CELLS", 8)
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for d in range(1, 7):                               # at each distance, also just beyond the radius
            for b in rng.sample(range(64), d):
                p ^= 1 << b
            prints.add(p)
    middle = rng.getrandbits(64)
    prints |= {middle ^ 1 << a ^ 1 << b for a in range(30) for b in range(a)}       # one dense family
    prints = sorted(prints)
    assert groups(prints, prints) != prints
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), len(prints))
    part = {r.node: r.component for r in components(links).collect()}
    got, want = [part.get(x, x) for x in signed], groups(prints, prints)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_cells_meet_every_variant():
    for bits in (0, 3, 9):
        x = np.array([5, 5 ^ 3, 5 ^ 12, 0xFF << 40], np.uint64)
        hashed = simhash.LinearHash(bits)
        met = [sorted(o.tolist()) for c in range(1 << bits) for _, o in simhash.collisions(x, c, bits)]
        assert sum(map(len, met)) > 0 and all(3 not in o for o in met)
        assert len(set(hashed.of(simhash.errors()).tolist())) <= 1 << bits
    assert simhash.cell_bits(1) == 6 and simhash.cell_bits(simhash.FILLED + 1) == 7


# 12 hard negatives

def mined(rows):
    sound = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, [math.floor(256 * float(x)) for x in v]) for i, l, v in rows
             if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(sound):
        if i is None or i % 100:
            continue
        scored = [(-max(-2 ** 63 + 1, min(2 ** 63 - 1, sum(x * y for x, y in zip(v, w)))), 2 ** 63 if j is None else j, j, other) for b, (j, other, w) in enumerate(sound) if a != b]
        scored.sort(key=lambda s: s[:2])
        for s, _, j, _ in [x for x in scored if x[3] == label][:5]:
            fit = [x for x in scored if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, j, r + 1, x[2], -s, -x[0]) for r, x in enumerate(fit)]
    return out


VECTORS = "vec_id bigint, label int, embedding array<double>, score int, uid string"


def vectors(seed, n, width, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        out.append((rng.randrange(400) if i % 5 else 100 * rng.randrange(4), rng.choice([0, 1, 2]), [scale * (x + rng.gauss(0, 0.4)) for x in c]))
    return out


@pytest.mark.parametrize("block, members, scale", [(4096, 512, 1.0), (40, 7, 1.0), (64, 8, 1e12)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, members, scale):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "MEMBERS", members)
    monkeypatch.setattr(negatives, "CHUNK", 50)
    nan, inf = float("nan"), float("inf")
    rows = vectors(3, 300, 6, scale) + [(None, 1, [0.5] * 6), (100, 2, None), (200, None, [1.0] * 6), (200, 1, [1.0, None]), (300, 1, [nan] * 6), (0, 1, [inf, 1.0]),
                                        (0, 0, []), (0, 0, [0.0] * 6), (500, 0, [0.25]), (500, 0, [0.25]), (500, 1, [0.25]), (707, 9, [0.2] * 6), (-100, 1, [0.1] * 6)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    got = negatives.mine(df).collect()
    assert key(tuple(r) for r in got) == key(mined(rows)) and len(got) > 100
    assert negatives.mine(df.where("vec_id = 1 AND label = 77")).collect() == []
    assert negatives.mine(df.limit(0)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_a_common_vector_ties_by_id(spark):
    rows = [(i, i % 2, [0.5, 0.5]) for i in range(200)]
    got = negatives.mine(spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)).collect()
    assert key(tuple(r) for r in got) == key(mined(rows))


def test_the_walk_ends_early_where_lists_are_tight():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 300
    points = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 5)
    members = np.floor(centres[0] + rng.normal(size=(8, 16)) * 5)
    everything = np.full((8, 1), negatives.NONE + 1), np.full((8, 1), negatives.MAX)
    i, _, c, score, walked = negatives.walk(members, points, np.ones((8, 4000), bool), *everything, 5)
    assert walked < 8 * 1000
    for m in range(8):
        assert sorted(score[i == m])[-5:] == sorted((points @ members[m]).astype(int))[-5:]


# 13 ranked search

def ranked(docs, items, depth=50):
    term = re.compile(lexical.TERM)
    bags = [(i, term.findall(brute.lower(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(len(b) for _, b in bags)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(term.findall(brute.lower(t)))
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, terms in asked.items():
        scored = []
        for i, b in bags:
            m = 100 - 50 + (50 * len(b) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b.count(t)) // (1000 * b.count(t) + 20 * m)) for t in terms if t in b)
            if s > 0:
                scored.append((-s, 2 ** 63 if i is None else i, i))
        scored.sort()
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:depth])]
    return out


@pytest.mark.parametrize("shard", [1 << 14, 7])
def test_search_equals_brute_force(spark, frame, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "ITEMS", 3)
    rng = random.Random(6)
    words = ["Ab", "cd", "e1", "éß", "gh", "ij", "kl", "mn", "op"]
    docs = [(i, " ".join(rng.choices(words, [9, 9, 5, 3, 2, 1, 1, 1, 1], k=rng.choice([1, 3, 3, 9, 40])))) for i in range(90)]
    docs += [(90, docs[3][1]), (91, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]), (95, None), (96, ""), (97, "-- !"), (98, "cd_CD`cd{ab"), (99, "gh " * 60_000)]
    items = [(1, "ab"), (2, "AB cd e1 cd"), (3, None), (4, "..."), (5, "nowhere"), (6, "mn op"), (6, "éß op"), (None, "gh kl"), (7, " ".join(words))]
    asked = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id bigint, text string, shard int, terms int")
    assert key(tuple(r) for r in lexical.search(frame(docs), asked, 12).collect()) == key(ranked(docs, items, 12))


def test_search_of_odd_and_no_rows(spark, frame, odd, empty):
    items = spark.createDataFrame([(1, "one word"), (1, "one word")], "item_id bigint, text string")
    rows = [r[:2] for r in ODD]
    assert key(tuple(r) for r in lexical.search(odd, items).collect()) == key(ranked(rows, [(1, "one word")]))
    assert lexical.search(empty, items).collect() == [] and lexical.search(odd, items.limit(0)).collect() == []


def test_terms_are_counted_piece_by_piece(monkeypatch):
    text = "A-b é_é 12 " * 50 + "x" * 80
    want = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PIECE", 9)
    assert lexical.term_counts(text) == want and want[b"a"] == 50 and want["é".encode()] == 100


def test_few_strata_are_visited_where_one_is_best():
    # 400 strata; only short documents hold the term often.
    m = np.repeat(np.arange(100, 500), 10)
    tf = np.where(m < 110, 9, 1)
    shard = lexical.Shard(m, np.ones(4000, int), np.zeros(4000, np.int64), tf, np.zeros(1, np.int64))
    place, score, visited = shard.best(np.zeros(1, int), np.ones(1, int), 50)
    assert visited < 40 and len(place) >= 50


# 1 neighbouring notices, 3 planted passages, 4 long texts, 6 summaries and loads

def test_scan_finds_a_notice_before_a_better_one():
    from turnwise.llm import licenses
    scanner = licenses.Scanner(licenses.BASE + licenses.NOTICES)
    for words in (["all", "rights", "reservd"] + ["all", "rights", "reserved"], ["all", "rights", "reservd"] * 9 + ["all", "rights", "reserved"]):
        spans = [s for s in scanner.spans([w.encode() for w in words]) if s["label"] == "reserved"]
        assert {s["first_word"] for s in spans} == set(range(0, len(words), 3))


def test_planted_passages_are_removed_and_flagged(spark, frame):
    from turnwise.llm import repeats
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(5, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(75, 90)) for _ in range(5)]
    assert all(len(p) >= 400 for p in passages)
    docs = [(i, prose(60) + " " + passages[i % 5] + " " + prose(60)) for i in range(20)] + [(100 + i, prose(150)) for i in range(20)]
    got = {r.doc_id: r for r in repeats.digests(repeats.remove_repeats(frame(docs))).collect()}
    assert all(got[i].repeated and got[i].n_removed >= 400 for i in range(20)) and not any(got[100 + i].repeated for i in range(20))


def test_pseudonyms_of_very_long_texts(frame):
    from odd_rows import LONG
    from turnwise.llm import pseudonyms
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(frame(LONG)).collect()}
    assert all(len(got[i].text) == len(t) for i, t in LONG) and got[20].n_email == 1 and got[24].n_email == 1 and got[24].text != LONG[4][1] and got[21].text == LONG[1][1]


def test_summary_keeps_frequent_values_in_bounded_room(monkeypatch):
    from turnwise.llm import jaccard
    monkeypatch.setattr(jaccard, "COUNTERS", 100)
    monkeypatch.setattr(jaccard, "PENDING", 500)
    rng, summary = np.random.default_rng(1), jaccard.Summary()
    often = np.arange(20, dtype=np.uint64)
    for _ in range(60):
        summary.add(np.concatenate([often, rng.integers(1000, 2 ** 60, 300).astype(np.uint64)]))
        assert len(summary.values) <= 100 and summary.held < 500
    summary.merge()
    assert set(often.tolist()) <= set(summary.values.tolist())


def test_parts_are_cut_by_bytes():
    import pyarrow as pa
    from turnwise.llm import hashing
    batch = pa.RecordBatch.from_arrays([pa.array([None, "x" * 50, "", "y" * 10, "z" * 10, "a"])], ["text"])
    parts = [p.column(0).to_pylist() for p in hashing.parts_of(batch, 0, 20)]
    assert sum(parts, []) == batch.column(0).to_pylist() and max(sum(len(x or "") for x in p) for p in parts if len(p) > 1) <= 20
    assert [p.num_rows for p in hashing.parts_of(pa.RecordBatch.from_arrays([pa.array(["b"] * 1000)], ["text"]), 0)] == [512, 488]


# the pipeline

def test_stages_of_odd_rows_and_of_no_rows(spark, tmp_path, odd, empty):
    import corpus_pipeline
    from turnwise.session import cut_lineage
    for docs in (odd, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut_lineage(stage(spark, docs, str(tmp_path)))
            assert docs.columns == columns, name
        assert "ids_sha256" in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns


def test_one_of_each_group_stays(frame):
    from turnwise.llm import jaccard
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(3, text), (2, text + " end"), (2, text + " end"), (7, text.upper()), (9, "other words stand here today"), (10, None), (11, ""), (None, None)]
    assert key(r.doc_id for r in jaccard.one_of_each(frame(docs)).collect()) == key([2, 9, 10, 11, None])


def test_the_pipeline_keeps_what_its_stages_keep(spark):
    """Exact and near-duplicate stages against brute force over what the quality rules kept, and no text twice in the end."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    from turnwise.session import cut_lineage
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ruled = cut_lineage(corpus_pipeline.quality_rules(spark, docs, SF))
    exact = cut_lineage(corpus_pipeline.exact_duplicates(spark, ruled, SF))
    best = {}
    for r in ruled.collect():
        best[brute.lower(r.text)] = max(best.get(brute.lower(r.text), -1), r.doc_id)
    assert {r.doc_id for r in exact.collect()} == set(best.values())
    near = cut_lineage(corpus_pipeline.near_duplicates(spark, exact, SF))
    part = brute.components([(r.doc_id, r.text) for r in exact.collect()])
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in part.items() if i == c}
    out = corpus_pipeline.run(spark, SF)
    mixed = corpus_pipeline.mixed_sources(spark, near, SF)
    assert key((r.doc_id, r.n) for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()) == key((r.doc_id, r.n) for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect())
