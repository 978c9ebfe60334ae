"""Queries for the text, date, hash and reply column functions."""
from pyspark.sql import functions as F

from ..functions import text as tx
from . import sqlkit as k
from .registry import plan

NL = "chr(10)"


def _docs(t):
    return t.documents.select("doc_id", "text", "lang", "source")


def _one(name, fn, sql_fn, extra_sql="", table="documents", key="doc_id"):
    @plan(name, f"select {key}, {sql_fn('text')} as out from {table} {extra_sql}")
    def build(t):
        return getattr(t, table).select(key, fn("text").alias("out"))


_one("txt_normalize_ws", tx.normalize_text, k.norm)
_one("txt_normalize_match", tx.normalize_for_match, k.norm_match)
_one("txt_normalize_source", tx.normalize_for_source_match, k.norm_source)
_one("txt_normalize_judge", tx.normalize_answer, k.norm_answer)
_one("txt_classify_question", tx.classify_question, lambda c: f"""case
 when regexp_matches(lower(trim({c})), 'how much|what amount|the amount|amount was|price|cost|dollar|\\$') then 'SINGLE_FACT'
 when regexp_matches(lower(trim({c})), 'when |what date|which date|how long|what time') then 'TEMPORAL'
 when regexp_matches(lower(trim({c})), 'how many|which of|what are |list ') then 'SET_COLLECTION'
 when starts_with(lower(trim({c})), 'why ') or contains(lower({c}), ' why ') then 'CAUSE_RESULT'
 when regexp_matches(lower(trim({c})), 'compare|difference|both |versus| vs ') then 'COMPARISON'
 when contains(lower(trim({c})), ' and ') and regexp_matches(lower({c}), 'who|what|how') then 'MULTIHOP'
 else 'SINGLE_FACT' end""")


@plan("txt_lexical_expansions", f"""
with w as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''_-]*'),
   lambda x: lower(x)), lambda x: length(x)>2 and not list_contains({k.slist(tx.STOP_EXPANSION)}, x)) w from documents),
 u as (select doc_id, unnest(w) as word, generate_subscripts(w,1) as i from w),
 f as (select doc_id, word, min(i) as i from u group by 1,2),
 r as (select *, row_number() over (partition by doc_id order by i) rn from f),
 g as (select doc_id, string_agg(word, ' ' order by i) s from r where rn<=12 group by 1)
select d.doc_id, coalesce(g.s,'evidence') as out from documents d left join g using (doc_id)""")
def _(t):
    return t.documents.select("doc_id", F.array_join(tx.lexical_expansions("text"), " ").alias("out"))


_MESSY_SQL = """select doc_id, case doc_id % 5 when 0 then '<think>plan
it</think> Answer: "'||text||'"' when 1 then '```json '||text||' ```' when 2 then 'Final answer - '||text
 when 3 then ' * '||text else text end as text from documents"""


def _messy(t):
    m = F.col("doc_id") % 5
    return t.documents.select("doc_id", F.when(m == 0, F.concat(F.lit('<think>plan\nit</think> Answer: "'), "text", F.lit('"')))
                              .when(m == 1, F.concat(F.lit("```json "), "text", F.lit(" ```")))
                              .when(m == 2, F.concat(F.lit("Final answer - "), "text"))
                              .when(m == 3, F.concat(F.lit(" * "), "text")).otherwise(F.col("text")).alias("text"))


@plan("txt_canonical_answer", f"""
with a as ({_MESSY_SQL}), b as (select doc_id, {k.norm('text')} s from a),
 c as (select doc_id, {k.strip("regexp_replace(s,'(?is)<think>.*?</think>','','g')")} s from b),
 d as (select doc_id, {k.strip("regexp_replace(s,'(?i)^```(?:json)?[[:space:]]*','')")} s from c),
 e as (select doc_id, {k.strip("regexp_replace(s,'[[:space:]]*```$','')")} s from d),
 f as (select doc_id, {k.strip("regexp_replace(s,'(?i)^(final[[:space:]]+answer|answer|response|hypothesis|prediction)[[:space:]]*[:-][[:space:]]*','')")} s from e),
 g as (select doc_id, trim(s, chr(32)||chr(9)||chr(13)||chr(10)||chr(39)||chr(34)||chr(96)) s from f),
 h as (select doc_id, regexp_replace(s,'^[[:space:]]*[-*•][[:space:]]*','') s from g)
select doc_id, {k.norm('s')} as out from h""")
def _(t):
    return _messy(t).select("doc_id", tx.canonicalize_answer("text").alias("out"))


_PROFILES = list(tx.TOKEN_PROFILES)


@plan("txt_tokens", " union all ".join(
    f"select doc_id, '{p}' as profile, len({k.toks('text', p)})::bigint as n, len({k.tokset('text', p)})::bigint as n_distinct,"
    f" md5(array_to_string({k.toks('text', p)},' ')) as fingerprint from documents" for p in _PROFILES))
def _(t):
    per = F.array(*[F.struct(F.lit(p).alias("profile"), tx.tokens("text", p).alias("t")) for p in _PROFILES])
    return t.documents.select("doc_id", F.explode(per).alias("p")).select(
        "doc_id", "p.profile", F.size("p.t").cast("bigint").alias("n"),
        F.size(F.array_distinct("p.t")).cast("bigint").alias("n_distinct"),
        F.md5(F.array_join("p.t", " ")).alias("fingerprint"))


CLAUSE_SQL = f"""
 c0 as (select {{key}}, {k.strip('text')} s from {{table}}),
 c1 as (select {{key}}, s, string_split(regexp_replace(regexp_replace(regexp_replace(s,
   '([.!?])\\s+','\\1'||chr(1),'g'), ';+\\s*',chr(1),'g'), '\\s+[—–]\\s+',chr(1),'g'), chr(1)) p from c0),
 c2 as (select {{key}}, s, list_filter(list_transform(p, lambda x: trim(x, {k.WS}||'-–—')), lambda x: x<>'') p from c1),
 c3 as (select {{key}}, s, flatten(list_transform(p, lambda x: string_split(regexp_replace(x,
   '(?i),\\s+(but|however|although|though|yet)\\b', chr(1)||'\\1','g'), chr(1)))) p from c2),
 c4 as (select {{key}}, s, list_filter(list_transform(p, lambda x: {k.strip('x')}), lambda x: x<>'') p from c3),
 clauses as (select {{key}}, unnest(case when len(p)>0 then p else [coalesce(nullif(s,''),'empty')] end) clause,
   generate_subscripts(case when len(p)>0 then p else [coalesce(nullif(s,''),'empty')] end, 1) as ord from c4)"""


@plan("txt_split_clauses", f"with {CLAUSE_SQL.format(key='doc_id', table='documents')} "
                           "select doc_id, ord::bigint as ord, clause from clauses")
def _(t):
    return t.documents.select("doc_id", F.posexplode(tx.split_clauses("text")).alias("o", "clause")).select(
        "doc_id", (F.col("o") + 1).cast("bigint").alias("ord"), "clause")


_NOTE_SQL = """select o_orderkey, case o_orderkey % 5
 when 0 then 'Due '||strftime(o_orderdate,'%Y-%m-%d')||' or '||strftime(o_orderdate,'%Y/%-m/%-d')
 when 1 then 'Seen on '||strftime(o_orderdate,'%-d %B %Y')||' again'
 when 2 then 'Left '||strftime(o_orderdate,'%B %-d, %Y')||' and 31 February 2023'
 when 3 then 'the 2nd may, 2021 then '||strftime(o_orderdate,'%-dth %b %Y') else 'no date' end as note from orders"""


def _notes(t):
    d, m = F.col("o_orderdate"), F.col("o_orderkey") % 5
    f = lambda p: F.date_format(d, p)
    return t.orders.select("o_orderkey", F.when(
        m == 0, F.concat(F.lit("Due "), f("yyyy-MM-dd"), F.lit(" or "), f("yyyy/M/d"))).when(
        m == 1, F.concat(F.lit("Seen on "), f("d MMMM yyyy"), F.lit(" again"))).when(
        m == 2, F.concat(F.lit("Left "), f("MMMM d, yyyy"), F.lit(" and 31 February 2023"))).when(
        m == 3, F.concat(F.lit("the 2nd may, 2021 then "), f("d"), F.lit("th "), f("MMM yyyy"))).otherwise(
        "no date").alias("note"))


_MON = "{" + ",".join(f"'{a}':{b}" for a, b in tx.MONTHS.items()) + "}"
_MONMAP = "map([" + ",".join(f"'{a}'" for a in tx.MONTHS) + "],[" + ",".join(str(b) for b in tx.MONTHS.values()) + "])"


def dates_sql(source, key, col):
    """Rows (key, d) of the distinct valid dates written in a text column."""
    forms = [(r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b", (1, 2, 3), False),
             (r"(?i)\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+),?\s+(\d{4})\b", (3, 2, 1), True),
             (r"(?i)\b([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b", (3, 1, 2), True)]
    parts = []
    for p, (y, m, d), named in forms:
        mon = f"{_MONMAP}[lower(regexp_extract(x,'{p}',{m}))]" if named else f"regexp_extract(x,'{p}',{m})::int"
        parts.append(f"""select {key}, try_cast(lpad(regexp_extract(x,'{p}',{y}),4,'0')||'-'||lpad(({mon})::varchar,2,'0')||'-'||
          lpad(regexp_extract(x,'{p}',{d}),2,'0') as date) d from (select {key}, unnest(regexp_extract_all({k.norm(col)},'{p}')) x from ({source}))""")
    return f"select distinct {key}, d from ({' union all '.join(parts)}) where d is not null"


@plan("txt_extract_dates", f"select o_orderkey, strftime(d,'%Y-%m-%d') as day from ({dates_sql(_NOTE_SQL, 'o_orderkey', 'note')})")
def _(t):
    return _notes(t).select("o_orderkey", F.explode(tx.extract_dates("note")).alias("day"))


@plan("txt_date_key", """select o_orderkey, case when o_orderkey % 5 < 3 then strftime(o_orderdate,'%Y-%m-%d') end as day from orders""")
def _(t):
    return _notes(t).select("o_orderkey", tx.date_key("note").alias("day"))


_TS_SQL = """select event_id, case event_id % 5 when 0 then strftime(ts,'%-I:%M %p on %-d %B, %Y')
  when 1 then strftime(ts,'%Y-%m-%dT%H:%M:%SZ') when 2 then strftime(ts,'%Y/%m/%d (%a) %H:%M')
  when 3 then floor(epoch(ts))::bigint::varchar else 'soon' end as said, date_trunc('minute', ts) as m from events"""


@plan("txt_parse_timestamp", f"""select event_id, said, case when event_id % 5 < 4 then strftime(m,'%Y-%m-%d %H:%M') end as minute,
  case when event_id % 5 < 4 then strftime(m,'%Y/%m/%d (%a) %H:%M') end as shown from ({_TS_SQL})""")
def _(t):
    ts, m = F.col("ts"), F.col("event_id") % 5
    said = (F.when(m == 0, F.date_format(ts, "h:mm a 'on' d MMMM, yyyy"))
            .when(m == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(m == 2, F.date_format(ts, "yyyy/MM/dd (EEE) HH:mm"))
            .when(m == 3, F.unix_timestamp(ts.cast("timestamp")).cast("string")).otherwise("soon"))
    e = t.events.select("event_id", said.alias("said")).withColumn("p", tx.parse_timestamp("said"))
    return e.select("event_id", "said", F.date_format("p", "yyyy-MM-dd HH:mm").alias("minute"),
                    tx.format_timestamp(F.col("p")).alias("shown"))


@plan("txt_render_assertion", """
with a as (select o_orderkey, c_name as subject, o_orderpriority as relation, o_orderstatus as value,
  case when o_orderkey % 3 = 0 then 'order event' end as event, strftime(o_orderdate,'%Y-%m-%d') as tm,
  case when o_orderkey % 4 = 0 then '' else c_name||' did '||o_orderpriority end as s from orders join customer on o_custkey=c_custkey),
 b as (select *, case when s<>'' then s else '' end as p0 from a),
 c as (select *, case when contains(lower(p0),lower(subject)) then p0 else concat_ws(' | ', nullif(p0,''), 'subject: '||subject) end p1 from b),
 d as (select *, case when contains(lower(replace(p1,' | ',' ')),lower(relation)) then p1 else concat_ws(' | ', nullif(p1,''), 'relation: '||relation) end p2 from c),
 e as (select *, case when contains(lower(replace(p2,' | ',' ')),lower(value)) then p2 else concat_ws(' | ', nullif(p2,''), 'value: '||value) end p3 from d),
 f as (select *, case when event is null or contains(lower(replace(p3,' | ',' ')),lower(event)) then p3 else concat_ws(' | ', nullif(p3,''), 'event: '||event) end p4 from e)
select o_orderkey, case when contains(lower(replace(p4,' | ',' ')),lower(tm)) then p4 else concat_ws(' | ', nullif(p4,''), 'time: '||tm) end as out from f""")
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    s = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat("c_name", F.lit(" did "), "o_orderpriority"))
    ev = F.when(F.col("o_orderkey") % 3 == 0, "order event")
    return j.select("o_orderkey", tx.render_assertion(
        s, "c_name", "o_orderpriority", "o_orderstatus", ev, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("out"))


@plan("txt_publish_query", """select item_id as sample_id, text as question,
 concat_ws(' | ', text, ents, nullif(rel,''), lex) as query_text from (
 select item_id, text, array_to_string(regexp_extract_all(text,'[A-Z][a-z]+'),' | ') ents,
  case when item_id % 2 = 0 then 'told about' else '' end rel, 'evidence' lex from benchmark) where ents <> ''
 union all select item_id, text, concat_ws(' | ', text, case when item_id % 2 = 0 then 'told about' end, 'evidence') from benchmark
 where array_to_string(regexp_extract_all(text,'[A-Z][a-z]+'),' | ') = ''""")
def _(t):
    from ..operators.contracts import publish_query
    q = t.benchmark.select(
        F.col("item_id").alias("sample_id"), F.col("text").alias("question"),
        F.struct(tx.find_all(F.col("text"), "[A-Z][a-z]+").alias("target_entities"),
                 F.array(F.when(F.col("item_id") % 2 == 0, "told about").otherwise("")).alias("relation_queries"),
                 F.array(F.lit("evidence")).alias("lexical_expansions")).alias("plan"))
    return publish_query(q).select("sample_id", "question", "query_text")


@plan("txt_query_views", """
with s as (select o_orderkey as sample_id, o_orderstatus as question, c_name as subject,
  case when o_orderkey % 2 = 0 then c_mktsegment end as evaluated, o_orderpriority as family,
  case when o_orderkey % 3 = 0 then c_name else 'event '||o_orderstatus end as ev, strftime(o_orderdate,'%Y') as temporal
  from orders join customer on o_custkey=c_custkey),
 p as (select sample_id, unnest([question, subject, evaluated, family, ev]) v, generate_subscripts([question, subject, evaluated, family, ev],1) i from s),
 d as (select sample_id, v, min(i) i from p where v is not null and v<>'' group by 1,2),
 pd as (select sample_id, string_agg(v,' | ' order by i) direct_view from d group by 1),
 p2 as (select sample_id, unnest([question, subject, evaluated, family, ev, temporal, subject]) v,
   generate_subscripts([question, subject, evaluated, family, ev, temporal, subject],1) i from s),
 d2 as (select sample_id, v, min(i) i from p2 where v is not null and v<>'' group by 1,2),
 ps as (select sample_id, string_agg(v,' | ' order by i) structured_view from d2 group by 1)
select sample_id, direct_view, structured_view from pd join ps using (sample_id)""")
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    s = j.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("question"),
                 F.col("c_name").alias("subject"), F.when(F.col("o_orderkey") % 2 == 0, F.col("c_mktsegment")).alias("evaluated"),
                 F.col("o_orderpriority").alias("family"),
                 F.when(F.col("o_orderkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("event "), "o_orderstatus")).alias("ev"),
                 F.date_format("o_orderdate", "yyyy").alias("temporal"))
    direct = tx.ordered_unique(F.array("question", "subject", "evaluated", "family"), F.array("ev"))
    structured = tx.ordered_unique(direct, F.array("temporal", "subject"))
    return s.select("sample_id", F.array_join(direct, " | ").alias("direct_view"),
                    F.array_join(structured, " | ").alias("structured_view"))


@plan("txt_fused_views", """select o_orderkey as sample_id, concat_ws(' | ', c_name, nullif(seg,''), o_orderpriority, 'FORWARD') as role_relation,
 concat_ws(' | ', c_name, nullif(seg,''), o_orderstatus) as event, concat_ws(' | ', c_name, y, o_orderstatus) as temporal,
 concat_ws(' | ', c_name, nullif(seg,''), o_orderpriority) as answer_slot from (
 select *, case when o_orderkey % 2 = 0 then c_mktsegment else '' end as seg, strftime(o_orderdate,'%Y') y from orders join customer on o_custkey=c_custkey)""")
def _(t):
    from ..operators.corpus import fused_views
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    c = j.select(F.col("o_orderkey").alias("sample_id"), F.col("c_name").alias("subject"),
                 F.when(F.col("o_orderkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("evaluated_subject"),
                 F.col("o_orderpriority").alias("family"), F.lit("FORWARD").alias("direction"),
                 F.array("o_orderstatus").alias("events"), F.date_format("o_orderdate", "yyyy").alias("temporal"),
                 F.lit(None).cast("string").alias("time_owner"), F.lit(None).cast("string").alias("answer_role"))
    return fused_views(c)


@plan("txt_doc_views", f"with {CLAUSE_SQL.format(key='conv_id, turn, role', table='conversations')} "
      "select conv_id, turn, ord::bigint as ord, clause as plain, role||' '||clause as speaker, "
      "role||' t'||turn||' '||clause as temporal from clauses")
def _(t):
    from ..operators.corpus import doc_views
    c = t.conversations.select("conv_id", "turn", F.col("role").alias("speaker"),
                               F.concat(F.lit("t"), F.col("turn")).alias("timestamp"), F.col("text").alias("raw_text"))
    return doc_views(c).select("conv_id", "turn", "ord", "plain", "speaker_view", "temporal").withColumnRenamed("speaker_view", "speaker")


@plan("txt_strip_speaker", "select conv_id, turn, "
      + k.strip("case turn % 3 when 2 then role||'ly: '||text else text end") + " as out from conversations")
def _(t):
    m = F.col("turn") % 3
    said = (F.when(m == 0, F.concat(F.upper("role"), F.lit(" :  "), F.col("text")))
            .when(m == 1, F.col("text")).otherwise(F.concat("role", F.lit("ly: "), "text")))
    return t.conversations.select("conv_id", "turn", tx.strip_speaker(said, "role").alias("out"))


@plan("txt_fact_range", """select event_id, event_type || case event_id % 4 when 0 then ' ('||v||' - '||w||')' when 1 then ' ('||v||' - now)'
 when 2 then ' (until '||w||')' else '' end as out from (select *, strftime(ts,'%Y-%m-%d') v, strftime(ts + interval 7 day,'%Y-%m-%d') w from events)""")
def _(t):
    m = F.col("event_id") % 4
    v = F.when(m < 2, F.date_format("ts", "yyyy-MM-dd"))
    w = F.when(m.isin(0, 2), F.date_format(F.date_add("ts", 7), "yyyy-MM-dd"))
    return t.events.select("event_id", tx.fact_range("event_type", v, w).alias("out"))


@plan("txt_token_estimate", f"""select doc_id, {k.count_tokens('text')}::bigint as n_tokens,
 case when length(s)<=120 then s else rtrim(s[1:117])||'...' end as short from (select *, {k.strip('text')} s from documents)""")
def _(t):
    return t.documents.select("doc_id", tx.token_estimate("text").cast("bigint").alias("n_tokens"),
                              tx.truncate("text", 120).alias("short"))


@plan("txt_focus_sections", f"""
with d as (select doc_id, {k.strip("replace(text, chr(10), chr(10)||chr(10))")} s from documents),
 q as (select {k.tokset("'the that with from this which'||' '||'entith onesen ering thand there'", 'lexical')} w),
 p as (select doc_id, s, unnest(string_split(regexp_replace(s,'\\n\\s*\\n',chr(1),'g'),chr(1))) x,
   generate_subscripts(string_split(regexp_replace(s,'\\n\\s*\\n',chr(1),'g'),chr(1)),1) i from d),
 sc as (select doc_id, {k.strip('x')} x, i, {k.inter(k.tokset('x','plain'),'w')} n from p, q),
 r as (select *, row_number() over (partition by doc_id order by n desc, i) rn from sc where n>0 and x<>''),
 b as (select doc_id, string_agg(x, chr(10)||chr(10) order by rn) t from r where rn<=4 group by 1)
select doc_id, md5(case when length(s)<=800 then s when t is null then regexp_replace(s[1:800],'\\s+$','')
 when length(t)>800 then regexp_replace(t[1:800],'\\s+$','') else t end) as out from d left join b using (doc_id)""")
def _(t):
    query = F.lit("the that with from this which entith onesen ering thand there")
    return t.documents.select("doc_id", F.md5(tx.focus_sections(
        query, F.replace("text", F.lit("\n"), F.lit("\n\n")), 4, 800)).alias("out"))


@plan("txt_answer_literals", """
with c as (select o_orderkey, 'Bought on '||strftime(o_orderdate,'%-d %B %Y')||' for '||floor(o_totalprice)::bigint as claim,
  'on '||case when o_orderkey % 3 = 0 then strftime(o_orderdate,'%-d %B') else strftime(o_orderdate,'%-d %B %Y') end||' it cost '||floor(o_totalprice)::bigint as quote from orders)
select o_orderkey, strftime(o_orderdate,'%Y') is not null and (o_orderkey % 3 <> 0 or strftime(o_orderdate,'%Y') in (strftime(o_orderdate,'%-d'), floor(o_totalprice)::bigint::varchar)) as supported
from orders join c using (o_orderkey)""")
def _(t):
    price = F.floor("o_totalprice").cast("string")
    claim = F.concat(F.lit("Bought on "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" for "), price)
    when = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d MMMM")).otherwise(
        F.date_format("o_orderdate", "d MMMM yyyy"))
    return t.orders.select("o_orderkey", tx.literals_supported(
        claim, F.concat(F.lit("on "), when, F.lit(" it cost "), price)).alias("supported"))


@plan("txt_parse_label", """select doc_id, case doc_id % 6 when 0 then case when quality=1 then 'CORRECT' else 'WRONG' end
  when 1 then case when quality=1 then 'CORRECT' else 'WRONG' end when 2 then case when quality=1 then 'CORRECT' else 'WRONG' end
  when 3 then 'WRONG' when 4 then 'WRONG' else case when quality=1 then 'CORRECT' else 'WRONG' end end as label,
 case doc_id % 6 when 3 then 'incorrect' when 4 then 'incorrect' else case when quality=1 then 'correct' else 'incorrect' end end as graded from labels""")
def _(t):
    word = F.when(F.col("quality") == 1, "CORRECT").otherwise("WRONG")
    m = F.col("doc_id") % 6
    reply = (F.when(m == 0, F.concat(F.lit('{"label":"'), word, F.lit('"}')))
             .when(m == 1, F.concat(F.lit('Verdict: {"label": "'), F.lower(word), F.lit('", "why": "x"} end')))
             .when(m == 2, F.concat(F.lit("I say "), word, F.lit(".")))
             .when(m == 3, F.lit('{"verdict":"CORRECT"}')).when(m == 4, F.lit("That is INCORRECT"))
             .otherwise(F.concat(F.lit("```json\n{\"label\":\""), word, F.lit('"}\n```'))))
    return t.labels.select("doc_id", tx.parse_label(reply).alias("label"), tx.parse_graded_label(reply).alias("graded"))


@plan("txt_parse_json_array", """select conv_id, turn, text as content, conv_id||':'||turn as source_turn_id from conversations where turn % 3 <> 2""")
def _(t):
    body = F.to_json(F.array(F.struct(F.col("text").alias("content"), F.array(
        F.concat_ws(":", "conv_id", "turn")).alias("source_turn_ids"))))
    m = F.col("turn") % 3
    reply = F.when(m == 0, F.concat(F.lit("Here: "), body, F.lit(" done"))).when(
        m == 1, F.concat(F.lit('{"memories": '), body, F.lit("}"))).otherwise("no items")
    return t.conversations.select("conv_id", "turn", F.explode(tx.parse_items(reply)).alias("x")).select(
        "conv_id", "turn", F.col("x.content").alias("content"), F.element_at("x.source_turn_ids", 1).alias("source_turn_id"))


@plan("txt_page_refs", """select o_orderkey, case o_orderkey % 4 when 0 then (case when o_orderkey % 7 < 5 then (o_orderkey % 7)::varchar end)
 when 1 then null when 2 then '1,3' else '2' end as pages from orders""")
def _(t):
    m = F.col("o_orderkey") % 4
    reply = (F.when(m == 0, F.concat(F.lit("Pages ["), F.col("o_orderkey") % 7, F.lit(", "), F.col("o_orderkey") % 7, F.lit("]")))
             .when(m == 1, F.lit("STOP [1]")).when(m == 2, F.lit("page 1, 3 and 1 or 9")).otherwise("2"))
    return t.orders.select("o_orderkey", F.nullif(F.array_join(tx.page_refs(reply, F.lit(5)), ","), F.lit("")).alias("pages"))


@plan("txt_truthy", """select doc_id, (case doc_id % 5 when 0 then ' Yes ' when 1 then quality::varchar when 2 then '是' when 3 then 'no' else '' end)
 in (' Yes ','1','是') as truthy from labels""")
def _(t):
    m = F.col("doc_id") % 5
    said = (F.when(m == 0, " Yes ").when(m == 1, F.col("quality").cast("string")).when(m == 2, "是")
            .when(m == 3, "no").otherwise(""))
    return t.labels.select("doc_id", tx.truthy(said).alias("truthy"))


@plan("txt_role", """select conv_id, turn, case when turn % 4 = 3 then 'assistant' else role end as role from conversations""")
def _(t):
    said = F.when(F.col("turn") % 4 == 3, " Bot").otherwise(F.initcap("role"))
    return t.conversations.select("conv_id", "turn", tx.normalize_role(said).alias("role"))


@plan("txt_task_type", """select event_id, case event_type when 'view' then 'T1_fact' when 'click' then 'T2_update' when 'error' then 'T2_update' when 'purchase' then 'preference' else 'T1_fact' end as session_map,
 case event_type when 'view' then ' Single_Hop ' when 'click' then 'temporal' when 'error' then 'ADVERSARIAL' when 'purchase' then 'T3_preference' else 'T1_fact' end as haystack,
 case event_type when 'view' then 'Single_Hop' when 'click' then 'temporal' when 'error' then 'ADVERSARIAL' when 'purchase' then 'preference' else 'generic' end as generic from events""")
def _(t):
    raw = (F.when(F.col("event_type") == "view", " Single_Hop ").when(F.col("event_type") == "click", "temporal")
           .when(F.col("event_type") == "error", "ADVERSARIAL").when(F.col("event_type") == "purchase", "preference"))
    return t.events.select("event_id", *[tx.task_type(raw, d).alias(d) for d in ("session_map", "haystack", "generic")])


@plan("txt_conversation_key", """select conv_id, turn, case turn % 4 when 0 then 'meta'||conv_id else 'c'||conv_id end as conversation_key from conversations""")
def _(t):
    m = F.col("turn") % 4
    base = F.concat(F.lit("c"), F.col("conv_id"))
    sid = (F.when(m == 1, F.concat(base, F.lit("__qa_"), "turn", F.lit("__qa_1")))
           .when(m == 2, F.concat(base, F.lit("__counterfactual"))).otherwise(base))
    meta = F.when(m == 0, F.concat(F.lit(" meta"), F.col("conv_id")))
    return t.conversations.select("conv_id", "turn", tx.conversation_key(sid, meta, F.lit(" ")).alias("conversation_key"))


@plan("txt_answer_candidates", """select o_orderkey, case when o_orderstatus = 'P' then o_orderpriority else o_orderpriority||'|'||o_orderstatus end as candidates,
 o_orderpriority as canonical, case o_orderkey % 6 when 0 then 'gold' when 1 then 'silver' when 2 then 'bronze' when 3 then 'exclude' else 'unlabeled' end as split,
 case when o_orderkey % 2 = 0 then o_orderpriority else 'T1_fact' end as question_group from orders""")
def _(t):
    from ..operators.contracts import answer_candidates
    m = F.col("o_orderkey") % 6
    s = t.orders.select("o_orderkey", F.array("o_orderpriority", F.lit(" ")).alias("answer"),
                        F.array("o_orderpriority", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))).alias("acceptable_answers"),
                        F.when(m == 0, " Gold").when(m == 1, "silver").when(m == 2, "BRONZE").when(m == 3, "exclude").when(m == 4, "odd").alias("quality"),
                        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("question_type"), F.lit("T1_fact").alias("task_type"))
    r = answer_candidates(s)
    return r.select("o_orderkey", F.array_join("candidates", "|").alias("candidates"), "canonical", "split", "question_group")


@plan("txt_canonical_hash", """select doc_id, sha256('{"lang":"'||lang||'","n":'||n_chars||',"source":"'||source||'"}') as key from documents""")
def _(t):
    return t.documents.select("doc_id", tx.content_key(
        source=F.col("source"), n=F.col("n_chars"), lang=F.col("lang")).alias("key"))


_GATE_SUBJ = "case conv_id % 3 when 0 then 'it' when 1 then role else '' end"


@plan("txt_context_gate", f"""select conv_id, turn, case when turn % 5 = 4 then 'CONTEXT_REPARSE_REQUIRED'
 when turn % 5 = 3 and conv_id % 3 = 2 then 'SELF_CONTAINED_LLM'
 when length({k.strip('text')}) <= 240 and regexp_matches({k.strip('text')}, '^\\s*(?i:yes|yeah|yep|no|nope|correct|exactly|right|sure|indeed|actually|instead|me too|same here|i agree|i disagree)\\b') then 'CONTEXT_REPARSE_REQUIRED'
 when length({k.strip('text')}) <= 240 and regexp_matches(text, '(?i)\\b(?:this|that|these|those|it|they|them|he|she|him|her|former|latter|there|then|the same|so do i|neither do i)\\b') and conv_id % 3 <> 1 then 'CONTEXT_REPARSE_REQUIRED'
 else 'SELF_CONTAINED_LLM' end as route from conversations""")
def _(t):
    m, c = F.col("turn") % 5, F.col("conv_id") % 3
    status = F.when(m == 4, "UNRESOLVED").when(m == 3, "NON_PROPOSITIONAL").otherwise("ASSERTED")
    empty = F.array().cast("array<string>")
    subjects = F.when(c == 0, F.array(F.lit("it"))).when(c == 1, F.array("role")).otherwise(empty)
    return t.conversations.select("conv_id", "turn", tx.context_gate("text", F.array(status), subjects).alias("route"))


@plan("txt_context_needed", """
with p as (select c.conv_id, c.turn, trim(regexp_replace(c.text,'\\s+',' ','g')) s, string_agg(b.text,' ' order by b.turn) prev
  from conversations c left join conversations b on b.conv_id=c.conv_id and b.turn between c.turn-3 and c.turn-1 group by 1,2,3),
 f as (select *, len(regexp_extract_all(s,'\\S+')) n, regexp_matches(s,'(?i)\\b(what|which|where|when|who|how|why)\\b') asks from p)
select conv_id, turn, case when coalesce(prev,'')='' then false
 when n<=16 and regexp_matches(s,'(?i)^\\s*(yes|yeah|yep|no|nope|exactly|right|correct|same|me too|so do i|i agree)\\b') then true
 when n<=6 and not asks then true
 when n<=16 and regexp_matches(s,'(?i)\\b(he|she|they|them|this|that|these|those|here|there|his|her|their|it)\\b')
  and (len(list_intersect(regexp_extract_all(lower(s),'[a-z]{3,}'),regexp_extract_all(lower(prev),'[a-z]{3,}')))>0
   or regexp_matches(s,'(?i)^\\s*(he|she|they|it|this|that|these|those|there|here)\\b')) then true
 when asks and n<=10 and not regexp_matches(s,'(?i)\\b(you|your|did|do|are|is|was|were)\\b') then true else false end as needed from f""")
def _(t):
    from ..operators.corpus import neighbors
    c = t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "text")
    n = neighbors(c, ["session"], "pos", 3, 0, ["text"])
    prev = F.array_join(F.transform("context", lambda x: x["text"]), " ")
    return n.select(F.col("session").alias("conv_id"), F.col("pos").alias("turn"),
                    tx.context_needed("text", prev).alias("needed"))
