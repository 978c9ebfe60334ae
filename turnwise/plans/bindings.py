"""The driver tables seen as turns, questions, records, facts, lanes and result rows.

Each view exists twice: as a DataFrame and as a SQL common table expression.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx

# -- conversations as turns ------------------------------------------------

TURNS = """turns as (select conv_id::varchar as conversation_id, turn as pos, turn//4+1 as session_no, turn%4+1 as idx,
 conv_id||'::D'||(turn//4+1)||':'||(turn%4+1) as raw_id, 'D'||(turn//4+1)||':'||(turn%4+1) as turn_id,
 'session_'||(turn//4+1) as session_id, role as speaker,
 strftime(date '2023-01-01' + (conv_id%300 + turn//4)::int, '%Y-%m-%d') as timestamp, text from conversations)"""


def turns(t) -> DataFrame:
    """Sessions of four turns; a day per session."""
    c = t.conversations
    session, idx = F.floor(F.col("turn") / 4) + 1, F.col("turn") % 4 + 1
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("conv_id") % 300 + F.floor(F.col("turn") / 4)).cast("int"))
    turn_id = F.concat(F.lit("D"), session, F.lit(":"), idx)
    return c.select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("pos"), session.alias("session_no"),
                    idx.alias("idx"), F.concat(F.col("conv_id"), F.lit("::"), turn_id).alias("raw_id"), turn_id.alias("turn_id"),
                    F.concat(F.lit("session_"), session).alias("session_id"), F.col("role").alias("speaker"),
                    F.date_format(day, "yyyy-MM-dd").alias("timestamp"), "text")


QUESTIONS = f"""{TURNS}, questions as (select raw_id as sample_id, conversation_id, pos, text as query_text, speaker,
 regexp_extract_all(lower(text),'[a-z0-9'']+') as targets from turns where speaker='user'),
 gold as (select q.sample_id, t.raw_id, t.turn_id, q.conversation_id from questions q join turns t on t.conversation_id=q.conversation_id and t.pos=q.pos+1)"""


def questions(t) -> DataFrame:
    """Every user turn asks; its words are the target entities."""
    u = turns(t).where("speaker = 'user'")
    return u.select(F.col("raw_id").alias("sample_id"), "conversation_id", "pos", F.col("text").alias("query_text"), "speaker",
                    tx.tokens("text", "plain").alias("targets"))


def gold(t) -> DataFrame:
    """The turn after a question is its evidence."""
    q = questions(t).select("sample_id", "conversation_id", (F.col("pos") + 1).alias("pos"))
    return q.join(turns(t).select("conversation_id", "pos", "raw_id", "turn_id"), ["conversation_id", "pos"]).drop("pos")


# -- facts, propositions, edges over turns ---------------------------------

_CLAUSES = """cl0 as (select *, trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) s from turns),
 cl1 as (select *, list_filter(list_transform(string_split(regexp_replace(s,'([.!?])\\s+','\\1'||chr(1),'g'),chr(1)),
   lambda x: trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))), lambda x: x<>'') p from cl0),
 clauses as (select conversation_id, raw_id, pos, session_id, speaker, timestamp, unnest(p) clause, generate_subscripts(p,1) ord from cl1)"""

FACTS = f"""{_CLAUSES}, facts as (select raw_id||'::a'||ord as assertion_id, raw_id, conversation_id, pos, session_id, timestamp, ord, speaker as subject,
 coalesce(w[1],'') as relation, coalesce(w[2],'') as value, case when ord%2=0 then coalesce(w[3],'') else '' end as event,
 case when ord%3=0 then timestamp else '' end as tm, 'POSITIVE' as polarity, 'UNKNOWN' as modality, 'ASSERTION' as speech_act,
 clause as retrieval_text from (select *, regexp_extract_all(lower(clause),'[a-z0-9'']+') w from clauses))"""


def facts(t) -> DataFrame:
    """One fact per sentence: speaker, first word, second word."""
    s = turns(t).select("conversation_id", "raw_id", "pos", "session_id", "speaker", "timestamp",
                        F.posexplode(F.filter(F.transform(F.split(tx.strip(F.col("text")), r"(?<=[.!?])\s+"), tx.strip),
                                              lambda x: x != "")).alias("o", "clause"))
    w = tx.tokens("clause", "plain")
    at = lambda i: F.coalesce(F.try_element_at(w, F.lit(i)), F.lit(""))
    ord_ = F.col("o") + 1
    return s.select(F.concat("raw_id", F.lit("::a"), ord_).alias("assertion_id"), "raw_id", "conversation_id", "pos", "session_id", "timestamp",
                    ord_.alias("ord"), F.col("speaker").alias("subject"), at(1).alias("relation"), at(2).alias("value"),
                    F.when(ord_ % 2 == 0, at(3)).otherwise("").alias("event"), F.when(ord_ % 3 == 0, F.col("timestamp")).otherwise("").alias("time"),
                    F.lit("POSITIVE").alias("polarity"), F.lit("UNKNOWN").alias("modality"), F.lit("ASSERTION").alias("speech_act"),
                    F.col("clause").alias("retrieval_text"))


EDGES = """edges as (
 select a.raw_id as source_raw_id, b.raw_id as target_raw_id, 'ANTECEDENT' as edge_type, a.conversation_id from turns a join turns b on a.conversation_id=b.conversation_id and b.pos=a.pos-1
 union all select a.raw_id, b.raw_id, 'OCCURRENCE', a.conversation_id from turns a join turns b on a.conversation_id=b.conversation_id and b.pos=a.pos-2 where a.pos%2=0
 union all select a.raw_id, b.raw_id, 'CONFIRMATION', a.conversation_id from turns a join turns b on a.conversation_id=b.conversation_id and b.pos=a.pos-3 where a.pos%3=0
 union all select a.raw_id, b.raw_id, 'REACTION', a.conversation_id from turns a join turns b on a.conversation_id=b.conversation_id and b.pos=a.pos-1 where a.pos%5=4)"""


def edges(t) -> DataFrame:
    """Typed links to the first, second and third predecessor."""
    a = turns(t).select("conversation_id", "pos", "raw_id")
    p = F.col("pos")
    link = lambda kind, back: F.struct(F.lit(kind).alias("edge_type"), F.lit(back).alias("back"))
    kinds = F.array(link("ANTECEDENT", 1), F.when(p % 2 == 0, link("OCCURRENCE", 2)), F.when(p % 3 == 0, link("CONFIRMATION", 3)),
                    F.when(p % 5 == 4, link("REACTION", 1)))
    s = a.select("conversation_id", F.col("raw_id").alias("source_raw_id"), p, F.explode(F.array_compact(kinds)).alias("k")).select(
        "conversation_id", "source_raw_id", (p - F.col("k.back")).alias("pos"), F.col("k.edge_type").alias("edge_type"))
    return s.join(a.select("conversation_id", "pos", F.col("raw_id").alias("target_raw_id")), ["conversation_id", "pos"]).drop("pos")


PROPS = """props as (select b.raw_id||'::p1' as proposition_id, b.raw_id, b.conversation_id, a.raw_id as source_raw_id,
  b.text as retrieval_text from turns b join turns a on a.conversation_id=b.conversation_id and a.pos=b.pos-1 where b.pos%2=1)"""


def propositions(t) -> DataFrame:
    """Each odd turn resolves against the turn before it."""
    b = turns(t).where("pos % 2 = 1")
    a = turns(t).select("conversation_id", (F.col("pos") + 1).alias("pos"), F.col("raw_id").alias("source_raw_id"))
    return b.join(a, ["conversation_id", "pos"]).select(F.concat("raw_id", F.lit("::p1")).alias("proposition_id"), "raw_id", "conversation_id",
                                                       "source_raw_id", F.col("text").alias("retrieval_text"))


# -- documents as a larger corpus ------------------------------------------

BENCH_QUESTIONS = """docs as (select doc_id::varchar as raw_id, 'all' as conversation_id, text, doc_id as ord from documents),
 bq as (select 'b'||item_id as sample_id, 'all' as conversation_id, text as passage, text as query_text from benchmark),
 bgold as (select b.sample_id, d.raw_id from bq b join docs d on contains(d.text, b.passage))"""


def docs(t) -> DataFrame:
    """All documents in one scope: the worst case for a scoped join."""
    return t.documents.select(F.col("doc_id").cast("string").alias("raw_id"), F.lit("all").alias("conversation_id"), "text", F.col("doc_id").alias("ord"))


def bench_questions(t) -> DataFrame:
    return t.benchmark.select(F.concat(F.lit("b"), F.col("item_id")).alias("sample_id"), F.lit("all").alias("conversation_id"),
                              F.col("text").alias("passage"), F.col("text").alias("query_text"))


# -- embeddings as vectors -------------------------------------------------

VECTORS = """vec as (select vec_id, 'v'||vec_id as doc_id, 'r'||(vec_id//3) as raw_id, label::varchar as conversation_id,
  list_transform(embedding, lambda x: x::double) as v from embeddings),
 qvec as (select 'q'||vec_id as sample_id, conversation_id, v from vec where vec_id%7=0)"""


def vectors(t) -> DataFrame:
    """Three consecutive vectors belong to one record (where they share a label)."""
    e = F.col("vec_id")
    return t.embeddings.select("vec_id", F.concat(F.lit("v"), e).alias("doc_id"), F.concat(F.lit("r"), F.floor(e / 3)).alias("raw_id"),
                               F.col("label").cast("string").alias("conversation_id"), F.col("embedding").cast("array<double>").alias("vec"))


def query_vectors(t) -> DataFrame:
    return vectors(t).where("vec_id % 7 = 0").select(F.concat(F.lit("q"), F.col("vec_id")).alias("sample_id"), "conversation_id", "vec")


# -- synthetic-free lanes: rankings of a customer's orders -----------------

LANES = """lanes as (
 select 'c'||o_custkey as sample_id, 'price' as family, 'price_desc' as lane, 'o'||o_orderkey as raw_id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders
 union all select 'c'||o_custkey, 'price', 'price_asc', 'o'||o_orderkey, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) from orders where o_orderstatus<>'P'
 union all select 'c'||o_custkey, 'date', 'newest', 'o'||o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) from orders
 union all select 'c'||o_custkey, 'date', 'oldest', 'o'||o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) from orders where o_orderstatus<>'F'
 union all select 'c'||o_custkey, 'urgency', 'priority', 'o'||o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) from orders)"""


#: Family, order and condition of each lane.
_RANKINGS = {
    "price_desc": ("price", lambda: F.desc("o_totalprice"), None),
    "price_asc": ("price", lambda: F.asc("o_totalprice"), "o_orderstatus <> 'P'"),
    "newest": ("date", lambda: F.desc("o_orderdate"), None),
    "oldest": ("date", lambda: F.asc("o_orderdate"), "o_orderstatus <> 'F'"),
    "priority": ("urgency", lambda: F.asc("o_orderpriority"), None),
}
#: Ids of a lane; bytes of orders (the optimizer's estimate) in a task, most tasks; orders of a customer beyond which slices of them are cut first.
_LANE, _PART_BYTES, _MOST_TASKS, _CROWD = 128, 1 << 20, 10_000, 8192


def _lane_ranks(orders: DataFrame, names, keys) -> DataFrame:
    """`orders` with a column per lane: the row's rank among those that the lane takes, null beyond its length."""
    from pyspark.sql import Window as W
    taken = {name: F.lit(True) if _RANKINGS[name][2] is None else F.coalesce(F.expr(_RANKINGS[name][2]), F.lit(False)) for name in names}
    ranked = orders
    for name in names:
        ranked = ranked.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(taken[name].desc(), _RANKINGS[name][1](), F.col("o_orderkey"))))
    return ranked.withColumns({name: F.when(taken[name] & (F.col(name) <= _LANE), F.col(name)) for name in names})


def lanes(t, only=tuple(_RANKINGS)) -> DataFrame:
    """Five rankings of each customer's orders in three families.

    Orders are dealt by customer once, to tasks of bounded size, and all lanes and what is grouped by sample are worked out there.
    A customer with very many orders is dealt in slices first, of which only rows that a lane of the slice takes go on.
    """
    from ..operators.scale import estimated_bytes, keyed_join
    from ..session import cut_lineage
    o = t.orders.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("sample_id"), "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority")
    tasks = max(t.spark.sparkContext.defaultParallelism, min(_MOST_TASKS, -(-estimated_bytes(o) // _PART_BYTES)))
    crowd = cut_lineage(o.groupBy("sample_id").agg(F.ceil(F.count(F.lit(1)) / _CROWD).cast("int").alias("_slices")).where("_slices > 1"))
    if not crowd.isEmpty():
        cut = keyed_join(o, crowd, ["sample_id"], "o_orderkey", "left").withColumn("_slice", F.pmod(F.xxhash64("o_orderkey"), "_slices").cast("int"))
        heads = _lane_ranks(cut.where("_slice is not null"), only, ["sample_id", "_slice"]).where(F.coalesce(*only).isNotNull())
        o = cut.where("_slice is null").select(*o.columns).unionByName(heads.select(*o.columns))
    ranks = _lane_ranks(o.repartition(tasks, "sample_id"), only, ["sample_id"])
    row = lambda name: F.when(F.col(name).isNotNull(), F.struct(F.lit(_RANKINGS[name][0]).alias("family"), F.lit(name).alias("lane"), F.col(name).cast("bigint").alias("rank")))
    each = ranks.select("sample_id", F.concat(F.lit("o"), "o_orderkey").alias("raw_id"), F.explode(F.array_compact(F.array(*map(row, only)))).alias("x"))
    return each.select("sample_id", "x.family", "x.lane", "raw_id", "x.rank")


LANE_GOLD = "lane_gold as (select 'c'||o_custkey as sample_id, 'o'||o_orderkey as raw_id from orders where o_orderkey%5=0)"


def lane_gold(t) -> DataFrame:
    return t.orders.where("o_orderkey % 5 = 0").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("sample_id"),
                                                       F.concat(F.lit("o"), F.col("o_orderkey")).alias("raw_id"))


# -- result rows -----------------------------------------------------------

RUN_LOG = """run_log as (select event_id as position, user_id::varchar as sample_id, event_type as system, value as latency,
 case when event_id%11=0 then 'timeout' end as error, case when event_id%7=0 then '  ' else 'answer '||event_id end as pred_answer,
 event_id%13=0 as incomplete_build, json_extract_string(props,'$.k')::int as tokens from events)"""


#: The systems of a run are named in its configuration: here, the event types.
SYSTEMS = ["view", "signup", "error", "click", "purchase"]


def each_system():
    return F.explode(F.array(*map(F.lit, SYSTEMS))).alias("system")


def run_log(t) -> DataFrame:
    """Events as an append-only journal of runs: key = (user, event type)."""
    e = F.col("event_id")
    return t.events.select(e.alias("position"), F.col("user_id").cast("string").alias("sample_id"), F.col("event_type").alias("system"),
                           F.col("value").alias("latency"), F.when(e % 11 == 0, "timeout").alias("error"),
                           F.when(e % 7 == 0, "  ").otherwise(F.concat(F.lit("answer "), e)).alias("pred_answer"), (e % 13 == 0).alias("incomplete_build"),
                           F.get_json_object("props", "$.k").cast("int").alias("tokens"))


JUDGED = """judged as (select l.doc_id::varchar as sample_id, d.source as system, d.lang as question_type, l.quality=1 as grade, l.toxic=1 as toxic,
  (l.doc_id%5+1)::varchar as category, d.text, d.n_chars from labels l join documents d on l.doc_id=d.doc_id)"""


def judged(t) -> DataFrame:
    """Labelled documents as judged answers: system = source, type = language, grade = quality."""
    j = t.labels.join(t.documents, "doc_id")
    return j.select(F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("system"), F.col("lang").alias("question_type"),
                    (F.col("quality") == 1).alias("grade"), (F.col("toxic") == 1).alias("toxic"),
                    (F.col("doc_id") % 5 + 1).cast("string").alias("category"), "text", "n_chars")
