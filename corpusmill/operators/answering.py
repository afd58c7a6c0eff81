"""Steps that a text model answers: plans, cited answers, attributions, facts, judgements.

A client is any picklable function from a list of prompts to a list of replies (None for
none), as with embeddings. Every step is a table of prompts, the replies, and the
validated reading of them; a reply is never trusted: quotes must stand in a source,
numbers must be in range, facts must have been said.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import rules as R
from corpusmill.operators import verify as V
from corpusmill.plans.staging import cut

Client = Callable[[list[str]], list[str | None]]

BATCH, PASSAGE = 16, 2500


def replies(prompts: DataFrame, client: Client, batch: int = BATCH) -> DataFrame:
    """(id, raw) for prompts (id, prompt); a call that fails gives null replies, not a failed job.

    Materialised, so that a client is asked once.
    """
    kind = prompts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column("prompt").to_pylist(), []
            for k in range(0, len(texts), batch):
                part = [t or "" for t in texts[k : k + batch]]
                try:
                    got = list(client(part))
                    out += got if len(got) == len(part) else [None] * len(part)
                except Exception:
                    out += [None] * len(part)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], names=["id", "raw"])

    return cut(prompts.select("id", "prompt").mapInArrow(run, f"id {kind}, raw string"))


def _lines(*parts: str | Column) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def planned_issues(questions: DataFrame, client: Client) -> DataFrame:
    """(id, n, issue): what a described situation (id, question, facts) raises, six at most.

    Only questions that look like a situation are planned; no reply plans nothing.
    """
    x = questions.where(T.situational(F.col("question")))
    ask = _lines("Which separate legal issues does this situation raise, asked about or not?", "Answer with three to six short search queries, one a line, and nothing else.", F.col("facts"), F.concat(F.lit("Situation: "), "question"))
    raw = replies(x.select("id", ask.alias("prompt")), client)
    return raw.where("raw is not null").select("id", F.posexplode(T.issue_lines(F.col("raw"))).alias("n", "issue"))


def cited_answers(prompts: DataFrame, sources: DataFrame, client: Client) -> tuple[DataFrame, DataFrame]:
    """(answers, quotes) for prompts (id, prompt) over sources (id, source, text).

    Answers are (id, answer): the reply's answer, or the reply itself where it is prose.
    Quotes are those of ``check_quotes`` that stand in a source.
    """
    ask = _lines(F.col("prompt"), "", 'Reply in JSON: {"answer": "..", "points": [{"source": n, "quote": "the source\'s own words", "applies": ".."}], "ask": ".."}')
    raw = replies(prompts.select("id", ask.alias("prompt")), client)
    answers = raw.select("id", F.trim(V.answer_text(F.coalesce("raw", F.lit("")))).alias("answer"))
    return answers, V.check_quotes(V.quote_points(raw), sources).where("kept")


def attributed_claims(answers: DataFrame, client: Client) -> DataFrame:
    """(id, claim, text, source) of each block that states a duty without a bracket, asked for once more.

    ``answers`` is (id, prompt, text, n_sources). A source is null where the reply names
    none that exists; a claim without a reply has null as well.
    """
    b = answers.select("id", "prompt", "n_sources", F.filter(T.blocks(F.col("text")), lambda x: x.rlike(T.DEONTIC) & ~x.rlike(V.BRACKET)).alias("claims")).where("size(claims) > 0")
    listed = F.array_join(F.transform("claims", lambda c, i: F.concat(i.cast("string"), F.lit(": "), c)), "\n")
    ask = _lines(F.col("prompt"), "", "Which source supports each of these statements? Null if none does.", listed, 'Reply in JSON: {"attributions": [{"claim": n, "source": n or null}]}')
    raw = replies(b.select("id", ask.alias("prompt")), client)
    found = V.attributions(raw.where("raw is not null").join(b.select("id", F.size("claims").alias("n_claims"), "n_sources"), "id"))
    claims = b.select("id", F.posexplode("claims").alias("claim", "text")).withColumn("claim", F.col("claim").cast("long"))
    return claims.join(found, ["id", "claim"], "left").select("id", "claim", "text", "source")


FACTS = "cpt_full_time_months double, unemployment_days array<double>"


def extracted_facts(questions: DataFrame, client: Client) -> DataFrame:
    """(id, cpt_full_time_months, unemployment_days) that questions (id, question) state.

    What the reply reads is kept only if the person said that number about that subject.
    """
    ask = _lines("Which of these does the question state: months of full-time training, days of unemployment?", F.col("question"), 'Reply in JSON: {"cpt_full_time_months": n or null, "unemployment_days": [n]}')
    raw = replies(questions.select("id", ask.alias("prompt")), client)
    x = questions.select("id", "question").join(raw, "id").select("id", "question", F.from_json("raw", FACTS).alias("j"))
    months, days = F.col("j.cpt_full_time_months"), F.col("j.unemployment_days")
    said = lambda ok, value: F.when(F.coalesce(ok, F.lit(False)), value)
    return x.select("id", said(R.months_stated(months, F.col("question")), months).alias("cpt_full_time_months"), said(R.days_stated(days, F.col("question")), days).alias("unemployment_days"))


def judged_claims(claims: DataFrame, passages: DataFrame, client: Client) -> DataFrame:
    """(id, flagged): claims (id, claim, facts) that a judge does not find in their passages
    (id, ord, citation, text). A reply that cannot be read flags the claim."""
    shown = F.concat(F.lit("Passage ("), "citation", F.lit("):\n"), F.substring("text", 1, PASSAGE))
    given = passages.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", shown.alias("p")))), lambda s: s["p"]), "\n\n").alias("given"))
    ask = _lines(F.coalesce("given", F.lit("")), "", F.coalesce("facts", F.lit("")), F.concat(F.lit("Claim: "), "claim"), "Do the passages or facts state or directly imply the claim, without any detail of its own?", 'Reply in JSON: {"verdict": "supported" or "not_supported"}')
    raw = replies(claims.join(given, "id", "left").select("id", ask.alias("prompt")), client)
    verdict = F.get_json_object(F.coalesce("raw", F.lit("")), "$.verdict")
    return raw.select("id", (F.coalesce(verdict, F.lit("")) != "supported").alias("flagged"))
