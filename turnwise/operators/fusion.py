"""Fusing lanes into candidates, and candidates into packets and prompts."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import text as tx
from .scale import top_k

DEPTH, K = 128, 20


def collapse_best(lanes: DataFrame) -> DataFrame:
    """Best rank of a record over the lanes of a family."""
    return lanes.where(F.col("rank") <= DEPTH).groupBy("sample_id", "family", "raw_id").agg(F.min("rank").alias("rank"))


def family_rrf(lanes: DataFrame, k: int = K) -> DataFrame:
    """Lanes of a family fused by reciprocal rank into new ranks."""
    s = lanes.where(F.col("rank") <= DEPTH).groupBy("sample_id", "family", "raw_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"))
    return top_k(s, ["sample_id", "family"], [F.desc("score"), F.asc("raw_id")], DEPTH).select("sample_id", "family", "raw_id", F.col("rank").cast("bigint").alias("rank"))


ARMS = ("RRF_BASELINE", "COMBMAX", "SHARP_RRF_P2", "BEST_PRIMARY_L025")


def fuse(families: DataFrame, k: int = K, arms: Sequence[str] = ARMS, depth: int = DEPTH) -> DataFrame:
    """Four ways to add up 1/(k+rank) over the families, one aggregation for all of them.

    families: sample_id, family, raw_id, rank
    """
    r = 1 / (k + F.col("rank"))
    g = families.groupBy("sample_id", "raw_id").agg(F.sum(r).alias("rrf"), F.max(r).alias("best"), F.sum(r * r).alias("sharp"))
    value = {"RRF_BASELINE": F.col("rrf"), "COMBMAX": F.col("best"), "SHARP_RRF_P2": F.col("sharp"), "BEST_PRIMARY_L025": F.col("best") + 0.25 * (F.col("rrf") - F.col("best"))}
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.round(value[a], 9).alias("score")) for a in arms])).alias("x")
    s = g.select("sample_id", "raw_id", each).select("sample_id", "raw_id", "x.*")
    return top_k(s, ["sample_id", "arm"], [F.desc("score"), F.asc("raw_id")], depth).select("sample_id", "arm", "raw_id", F.col("rank").cast("bigint").alias("rank"), "score")


# Quotas of the four lexical arms, lanes in filling order.
QUOTAS = {
    "LEX_BALANCED": [("raw", 28), ("assertion", 36), ("proposition", 16), ("entity", 16), ("graph", 32)],
    "ASSERT_GRAPH": [("assertion", 44), ("graph", 40), ("raw", 20), ("entity", 16), ("proposition", 8)],
    "RAW_GRAPH": [("raw", 40), ("graph", 40), ("assertion", 24), ("entity", 16), ("proposition", 8)],
    "SET_HEAVY": [("graph", 48), ("assertion", 32), ("entity", 20), ("raw", 20), ("proposition", 8)],
}
LANE_ORDER = ("raw", "assertion", "proposition", "entity", "graph")


def quota_fill(lanes: DataFrame, spec: dict = QUOTAS, order: Sequence[str] = LANE_ORDER, limit: int = DEPTH) -> DataFrame:
    """The quota arms: n unseen ids per lane in turn, then one more from each lane round and round up to the limit.

    lanes: sample_id, lane, raw_id, rank. A query's lanes are lists of at most 128 ids; both steps are folds over them.
    """
    head = lanes.where(F.col("rank") <= DEPTH).groupBy("sample_id", "lane").agg(F.array_sort(F.collect_list(F.struct("rank", "raw_id"))).alias("r"))
    per = head.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("lane", F.col("r.raw_id").alias("ids")))).alias("ids"))
    per = per.withColumn("size", F.least(F.lit(limit), F.size(F.array_distinct(F.flatten(F.map_values("ids"))))))
    quota = lambda lane, n: F.struct(F.lit(lane).alias("lane"), F.lit(n).alias("n"))
    arms = F.explode(F.array(*[F.struct(F.lit(arm).alias("arm"), F.array(*[quota(*q) for q in amounts]).alias("quotas")) for arm, amounts in spec.items()]))
    fresh = lambda out, lane: F.array_except(F.coalesce(F.try_element_at("ids", lane), F.array().cast("array<string>")), out)
    take = lambda out, lane, n: F.concat(out, F.slice(fresh(out, lane), F.lit(1), F.greatest(F.least(n, F.col("size") - F.size(out)), F.lit(0))))
    rows = per.select("*", arms.alias("a")).withColumn("out", F.aggregate("a.quotas", F.array().cast("array<string>"), lambda out, q: take(out, q["lane"], q["n"])))
    turns = F.sequence(F.lit(0), F.col("size") * len(order) - 1)
    lane_of = lambda i: F.element_at(F.array(*map(F.lit, order)), i % len(order) + 1)
    full = F.when((F.col("size") == 0) | (F.size("out") >= F.col("size")), F.col("out")).otherwise(
        F.aggregate(turns, F.col("out"), lambda out, i: F.when(F.size(out) >= F.col("size"), out).otherwise(take(out, lane_of(i), F.lit(1)))))
    return rows.select("sample_id", F.col("a.arm").alias("arm"), F.posexplode(full).alias("p", "raw_id")).select("sample_id", "arm", "raw_id", (F.col("p") + 1).cast("bigint").alias("rank"))


def layer_collapse(streams: DataFrame, keys: Sequence[str] = ("sample_id", "layer"), worse_first: bool = True) -> DataFrame:
    """Ranking of a layer's streams: support, then reciprocal sum, best rank and id.

    Equal support puts the smaller reciprocal sum — worse ranks — first unless `worse_first` is off.
    """
    g = streams.where(F.col("rank") <= DEPTH).groupBy(*keys, "raw_id").agg(
        F.count(F.lit(1)).alias("support"), F.round(F.sum(1 / (K + F.col("rank"))), 12).alias("mass"), F.min("rank").alias("best"))
    mass = F.asc("mass") if worse_first else F.desc("mass")
    return top_k(g, keys, [F.desc("support"), mass, F.asc("best"), F.asc("raw_id")], None).withColumn("rank", F.col("rank").cast("bigint"))


def consensus(layers: DataFrame, depth: int = 192) -> DataFrame:
    """Ids by the number of layers holding them, then reciprocal sum. layers: sample_id, layer, raw_id, rank"""
    g = layers.where(F.col("rank") <= depth).groupBy("sample_id", "raw_id").agg(F.countDistinct("layer").alias("n_layers"), F.round(F.sum(1 / (K + F.col("rank"))), 12).alias("mass"))
    return top_k(g, ["sample_id"], [F.desc("n_layers"), F.desc("mass"), F.asc("raw_id")], None).withColumn("rank", F.col("rank").cast("bigint"))


# Core sizes, per-layer quotas by question kind, and closure sizes of the routed arms.
ROUTES = {
    "L123_BALANCED": {"core": 48, "core_support": 2, "default": (34, 24, 14), "set": (28, 30, 14), "multi": (26, 24, 22), "temporal": (34, 18, 20), "closure": 8},
    "L123_RAW_PRIMARY": {"core": 48, "core_support": 2, "default": (44, 18, 10), "set": (36, 24, 12), "multi": (34, 18, 20), "temporal": (44, 12, 16), "closure": 8},
    "L123_STRUCTURE_PRIMARY": {"core": 40, "core_support": 2, "default": (30, 26, 22), "set": (24, 32, 22), "multi": (22, 26, 30), "temporal": (30, 18, 30), "closure": 10},
    "L123_HIGH_CONSENSUS": {"core": 64, "core_support": 2, "default": (26, 18, 12), "set": (22, 22, 12), "multi": (20, 18, 18), "temporal": (26, 12, 18), "closure": 8},
}
KIND_ROUTE = {"SET_COLLECTION": "set", "COMPARISON": "set", "MULTIHOP": "multi", "CAUSE_RESULT": "multi", "TEMPORAL": "temporal"}


def route(kind: str, layers: list[list[str]], agreed: list[tuple[str, int]], links: list[tuple[str, str, bool, int]], fallback: list[str], cfg: dict, limit: int = DEPTH) -> list[str]:
    """One query's candidates: the agreed core, layer quotas, a bounded closure over links, then completion.

    links: (anchor, neighbour, necessary, degree)
    """
    quotas = cfg[KIND_ROUTE.get(kind, "default")]
    support = dict(agreed)
    out = dict.fromkeys([rid for rid, n in agreed if n >= cfg["core_support"]][:cfg["core"]])
    for ranking, n in zip(layers, quotas):
        room = max(limit - len(out), 0)
        out.update(dict.fromkeys([r for r in ranking if r not in out][:min(n, room)]))
    place = {rid: i for i, rid in enumerate(out)}
    near = sorted({(not need, -support.get(b, 0), place[a], degree, b) for a, b, need, degree in links
                   if a in place and b not in place and (support.get(b, 0) or need)})
    stop = min(limit, cfg["core"] + sum(quotas) + cfg["closure"])
    for *_, rid in near:
        if rid in out:
            continue
        out[rid] = None
        if len(out) == stop:
            break
    result = dict.fromkeys(list(out)[:limit])
    for rid in fallback:
        if len(result) >= limit:
            break
        result.setdefault(rid)
    return list(result)


def routed_candidates(streams: DataFrame, kinds: DataFrame, links: DataFrame, roles: DataFrame, routes: dict = ROUTES) -> DataFrame:
    """Query-routed selection over three layers of streams.

    streams: sample_id, layer (1–3), stream, raw_id, rank; kinds: sample_id, query_kind; links: a, b undirected;
    roles: raw_id, necessary. Per query the group holds its pool (at most 19 × 128 ids) and the links
    that can matter: links into the pool, and per anchor the first 138 necessary neighbours outside it.
    """
    layer = layer_collapse(streams)
    agreed = consensus(layer)
    whole = layer_collapse(streams, ["sample_id"])
    pool = streams.select("sample_id", "raw_id").distinct()
    degree = links.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("degree"))
    # the first necessary neighbours of a node do not depend on the query, so hubs are cut before the join
    need = links.join(roles.where("necessary").select(F.col("raw_id").alias("b")), "b").join(degree, "b")
    best = top_k(need, ["a"], [F.asc("degree"), F.asc("b")], DEPTH * 19 + 138, "_r").select(F.col("a").alias("anchor"), "b", F.lit(True).alias("necessary"), "degree")
    outside = pool.join(best.withColumnRenamed("anchor", "raw_id"), "raw_id").select("sample_id", F.col("raw_id").alias("anchor"), "b", "necessary", "degree")
    inside = pool.join(links.withColumnRenamed("a", "raw_id"), "raw_id").select("sample_id", F.col("raw_id").alias("anchor"), "b").join(
        pool.select("sample_id", F.col("raw_id").alias("b")), ["sample_id", "b"]).join(degree, "b").join(
        roles.select(F.col("raw_id").alias("b"), "necessary"), "b", "left").select("sample_id", "anchor", "b", F.coalesce("necessary", F.lit(False)).alias("necessary"), "degree")
    link_rows = outside.unionByName(inside).distinct()
    # A part of a sample is one row with its list, so what is gathered by sample is a few rows each.
    def part(df: DataFrame, kind: str, x, y, n, d) -> DataFrame:
        item = F.struct(d.cast("long").alias("d"), x.alias("x"), y.alias("y"), n.cast("long").alias("n"))
        return df.groupBy("sample_id").agg(F.collect_list(item).alias("items")).select("sample_id", F.struct(F.lit(kind).alias("part"), "items").alias("p"))

    none = F.lit(None).cast("string")
    rows = (part(layer, "layer", F.col("raw_id"), none, F.col("layer"), F.col("rank"))
            .unionByName(part(agreed, "agreed", F.col("raw_id"), none, F.col("n_layers"), F.col("rank")))
            .unionByName(part(whole, "whole", F.col("raw_id"), none, F.lit(0), F.col("rank")))
            .unionByName(part(link_rows, "link", F.col("anchor"), F.col("b"), F.col("necessary").cast("int"), F.col("degree")))
            .unionByName(part(kinds, "kind", F.col("query_kind"), none, F.lit(0), F.lit(0))))
    out = T.StructType([T.StructField("sample_id", streams.schema["sample_id"].dataType), T.StructField("arm", T.StringType()), T.StructField("raw_id", T.StringType()), T.StructField("rank", T.LongType())])
    return rows.groupBy("sample_id").agg(F.collect_list("p").alias("parts")).mapInArrow(_picked(routes), out)


#: Samples whose lists are Python objects at a time.
PICKED = 256


def _picked(routes: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PICKED):
                yield pick(batch.slice(at, PICKED))

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        arms, ids, ranks, owner = [], [], [], []
        for row, parts in enumerate(batch.column("parts").to_pylist()):
            by = {p["part"]: sorted(p["items"], key=lambda r: r["d"]) for p in parts}
            layers = [[r["x"] for r in by.get("layer", ()) if r["n"] == i] for i in (1, 2, 3)]
            agreed = [(r["x"], r["n"]) for r in by.get("agreed", ())]
            links = [(r["x"], r["y"], r["n"] == 1, r["d"]) for r in by.get("link", ())]
            whole = [r["x"] for r in by.get("whole", ())]
            kind = by["kind"][0]["x"] if "kind" in by else "SINGLE_FACT"
            for arm, cfg in routes.items():
                got = route(kind, layers, agreed, links, whole, cfg)
                arms += [arm] * len(got)
                ids += got
                ranks += range(1, len(got) + 1)
                owner += [row] * len(got)
        sample = batch.column("sample_id").take(pa.array(owner, pa.int64()))
        return pa.RecordBatch.from_arrays([sample, pa.array(arms, pa.string()), pa.array(ids, pa.string()), pa.array(ranks, pa.int64())], ["sample_id", "arm", "raw_id", "rank"])

    return run


def prefix(ranking: DataFrame, ks: Sequence[int] = (10, 20)) -> DataFrame:
    """Top-k packets as prefixes of one ranking."""
    return ranking.where(F.col("rank") <= max(ks)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))


def packet(topk: DataFrame, raws: DataFrame, facts: DataFrame, budget: int = 0) -> DataFrame:
    """Evidence rows: original text (cut to the budget), speaker, time, caption and fact texts in order.

    facts: raw_id, ord, retrieval_text
    """
    lines = facts.join(topk.select("raw_id").distinct(), "raw_id", "left_semi").groupBy("raw_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "retrieval_text"))), lambda x: x["retrieval_text"]), "\n").alias("memory_assertions"))
    text = F.col("raw_text")
    cut = text if budget <= 0 else F.when(F.length(text) > budget, F.concat(F.substring(text, 1, budget), F.lit("\n[raw session truncated by answer budget]"))).otherwise(text)
    j = topk.join(raws, "raw_id").join(lines, "raw_id", "left")
    return j.select("sample_id", "raw_id", "rank", "speaker", F.col("timestamp").alias("source_timestamp"), cut.alias("original_text"),
                    F.coalesce("memory_assertions", F.lit("")).alias("memory_assertions"), F.coalesce("image_caption", F.lit("")).alias("image_caption"))


def prompts(lines: DataFrame, questions: DataFrame) -> DataFrame:
    """One prompt per sample: memory block, question, injected ids in order and a token estimate.

    lines: sample_id, rank, entry_id, line — a top-k, so a prompt gathers k rows.
    """
    got = F.array_sort(F.collect_list(F.struct("rank", "entry_id", "line")))
    g = lines.groupBy("sample_id").agg(got.alias("g"))
    j = questions.join(g, "sample_id", "left")
    block = F.coalesce(F.array_join(F.transform("g", lambda x: x["line"]), "\n"), F.lit(""))
    user = F.concat(F.lit("Question: "), "question")
    return j.select("sample_id", block.alias("memory_context"), F.concat(block, F.lit("\n\n"), user).alias("full_prompt"),
                    F.coalesce(F.array_join(F.transform("g", lambda x: x["entry_id"]), ","), F.lit("")).alias("injected_entry_ids"),
                    tx.token_estimate(F.concat(block, F.lit("\n"), user)).cast("bigint").alias("token_count"))


def injection_positions(lines: DataFrame) -> DataFrame:
    """Place of each injected entry in its prompt."""
    return lines.select("sample_id", "entry_id", (F.col("rank") - 1).cast("bigint").alias("position"))


def prompt_sections(items: DataFrame) -> DataFrame:
    """Titled sections in order, items in order inside; `system` sections move to the system prompt.

    items: sample_id, section_no, title, target, rank, content
    """
    row = F.struct("rank", F.concat(F.lit("["), F.col("rank") - 1, F.lit("] "), "content").alias("line"))
    s = items.groupBy("sample_id", "target", "section_no", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "\n").alias("body"))
    sect = F.struct("section_no", F.concat("title", F.lit(":\n"), "body").alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(sect)), lambda x: x["text"]), "\n\n")
    return s.groupBy("sample_id", "target").agg(whole.alias("context"), F.count(F.lit(1)).alias("n_sections"))


def page_prompt(store: DataFrame, selected: DataFrame) -> DataFrame:
    """All pages in order as lines, selected ones in full, the others as gists.

    store: conversation_id, page, gist, content; selected: sample_id, conversation_id, page. Rows stay
    per page, so a conversation of any length renders without gathering it.
    """
    asks = selected.select("sample_id", "conversation_id").distinct()
    sel = selected.select("sample_id", "page", F.lit(True).alias("picked")).distinct()
    j = asks.join(store, "conversation_id").join(sel, ["sample_id", "page"], "left")
    return j.select("sample_id", "page", F.coalesce("picked", F.lit(False)).alias("in_full"), F.when(F.col("picked"), F.col("content")).otherwise(F.col("gist")).alias("line"))
