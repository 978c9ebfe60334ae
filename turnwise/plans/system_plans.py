"""Queries for the memory-system contract and the pluggable scorer."""
import pandas as pd
from pyspark.sql import functions as F

from .. import systems
from ..functions import text as tx
from ..functions.python_udfs import score_pairs
from . import bindings as b, sqlkit as k
from .lane_plans import _TFIDF, _TOV, filled, word_share, word_share_sql
from .registry import plan

_DOCS = f"ent as (select conversation_id, raw_id, 'turn:'||raw_id entry_id, speaker||': '||{k.strip('text')} as text, pos as ord from turns)"


@plan("ext_memory_system", f"""with {b.QUESTIONS}, {_DOCS}, {_TFIDF.format(docs='ent', queries='questions')}, {filled('lt', 'questions', 'ent', 'tr', 'ord', 5)}, {_TOV.format(q='questions', d='ent')}, {filled('lx', 'questions', 'ent', 'ot', 'ord', 5)}
select 'simple_vector_tfidf' as system, sample_id, rank, 'turn:'||raw_id as entry_id, score from lt union all select 'lexical_fallback', sample_id, rank, 'turn:'||raw_id, score from lx""")
def _(t):
    return systems.run_all(["simple_vector_tfidf", "lexical_fallback"], b.turns(t), b.questions(t), 5)


_CURRENT = f"""cm as (select raw_id||'#'||ord as raw_id, conversation_id, clause as text, pos*1000+ord as ord, 'D'||(pos//4+1)||':'||(pos%4+1)||':memory:'||ord as entry_id from clauses where pos%2=1
 union all select raw_id, conversation_id, speaker||': '||{k.strip('text')}, pos*1000, turn_id from turns t where {k.strip('text')}<>'' and (pos%2=0 or not exists (select 1 from clauses c where c.raw_id=t.raw_id)))"""


@plan("ext_current_memory", f"""with {b.QUESTIONS}, {b.FACTS}, {_CURRENT}, {_TFIDF.format(docs='cm', queries='questions')}, {filled('lt', 'questions', 'cm', 'tr', 'ord', 5)}
select lt.sample_id, lt.rank, cm.entry_id, lt.score from lt join cm using (raw_id)""")
def _(t):
    """The current-memory system where every other turn is remembered by its sentences."""
    told = b.facts(t).where("pos % 2 = 1").groupBy("raw_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "retrieval_text"))), lambda x: x["retrieval_text"]).alias("current_memory_texts"))
    return systems.build("current_memory").run(b.turns(t).join(told, "raw_id", "left"), b.questions(t), 5).retrieved.select("sample_id", "rank", "entry_id", "score")


@plan("ext_system_lower_bound", f"with {b.QUESTIONS} select sample_id, '' as memory_context, '' as injected_entry_ids, len(regexp_extract_all('Question: '||query_text,'\\S+'))::bigint as token_count from questions")
def _(t):
    return systems.build("no_memory").run(b.turns(t), b.questions(t), 5).prompts.drop("full_prompt")


@plan("ext_system_upper_bound", f"with {b.TURNS} select conversation_id as sample_id, (pos+1)::bigint as rank, 'turn:'||raw_id as entry_id, speaker||': '||{k.strip('text')} as content, 1.0::double as score from turns")
def _(t):
    return systems.build("full_context").run(b.turns(t), b.questions(t), 5).retrieved


@plan("ext_scorer", f"""with p as ({word_share_sql(5)}), {b.QUESTIONS} select p.sample_id, p.raw_id, p.score, round(p.score*1000/(1000+length(t.text)),6) as adjusted from p join turns t on t.raw_id=p.raw_id""")
def _(t):
    """A scorer of one's own twice: over scoped pairs in blocks, then over the rows it left."""
    top = word_share(t, 5).join(b.turns(t).select("raw_id", F.length("text").alias("n")), "raw_id").select("sample_id", "raw_id", "score", "n")

    def by_length(pdf: pd.DataFrame):
        return pdf["score"] * 1000 / (1000 + pdf["n"])

    return score_pairs(top, by_length, out="adjusted", length="n").select("sample_id", "raw_id", "score", F.round("adjusted", 6).alias("adjusted"))


@plan("ext_explode_items", """select conv_id||':'||turn as response_id, conv_id||':'||turn||'#'||n as entry_id, case n when 1 then text else role end as content from conversations, (values (1),(2)) v(n)""")
def _(t):
    c = t.conversations
    reply = F.concat(F.lit("Sure: "), F.to_json(F.array(F.struct(F.col("text").alias("content")), F.struct(F.col("role").alias("content")))))
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("response_id"), F.posexplode(tx.parse_items(reply)).alias("i", "x")).select(
        "response_id", F.concat("response_id", F.lit("#"), F.col("i") + 1).alias("entry_id"), F.col("x.content").alias("content"))
