"""Context assembly: facts, events and beliefs an audience may see, fitted to a shared budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scoring import lexical_score
from palimpsest.functions.text import terms
from palimpsest.operators import ledger


def context(facts: DataFrame, events: DataFrame, knowledge: DataFrame, query: str, *, audience: str, limit: int, budget: int, reserved: int = 0, known: DataFrame | None = None) -> DataFrame:
    """used and picked (ledger, index, item, size): what fits, best first.

    Facts and beliefs are cut to the best `limit` and only then filtered for
    players, so players may get fewer; events are filtered first and cut to
    their tail.  Scores add importance or confidence over 20, or recency.
    """
    asked = terms(F.lit(query or " "))
    text = lambda *names: F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names])
    titles = {"facts": text("fact_key", "subject", "subject_ref", "predicate"), "knowledge": text("knowledge_key", "subject_ref", "epistemic_status")}
    best_facts = ledger.ledger_search(facts.where("status = 'active'"), query, limit, title=titles["facts"], content=F.col("content"), order=["-importance", "fact_key"])
    best_known = ledger.ledger_search(knowledge.where(~F.col("epistemic_status").isin(*ledger.INACTIVE_KNOWLEDGE)), query, limit, title=titles["knowledge"], content=F.col("proposition"), order=["knowledge_key"])
    if audience == "player":
        best_facts = best_facts.where(F.col("disclosure_scope").isin(*ledger.PLAYER_FACTS))
        best_known = best_known.where(F.col("disclosure_scope").isin(*ledger.PLAYER_KNOWLEDGE))
    seen = ledger.tail(ledger.audience_events(events, audience, known), limit, ["sequence", "event_id"])

    def candidates(rows: DataFrame, name: str, score: F.Column, order: list[F.Column]) -> DataFrame:
        item = F.to_json(F.struct(*[c for c in rows.columns if c != "score"]))
        n = F.row_number().over(ledger.Window.partitionBy(F.lit(name)).orderBy(*order)) - 1
        own = rows.withColumns({"index": n, "n": F.count("*").over(ledger.Window.partitionBy(F.lit(name)))})
        return own.select(F.lit(0).alias("request"), F.lit(name).alias("ledger"), "index", score.alias("score"), item.alias("item"), F.length(item).alias("size"))

    # These lists hold `limit` rows at most, so their windows are small.
    every = candidates(best_facts, "facts", F.col("score") + F.col("importance") / 20, [F.desc("score"), F.desc("importance"), F.asc("fact_key")])
    every = every.unionByName(candidates(best_known, "actor_knowledge", F.col("score") + F.col("confidence") / 20, [F.desc("score"), F.asc("knowledge_key")]))
    own = lexical_score(asked, F.col("event_type"), F.coalesce("retrieval_text", "summary"))
    every = every.unionByName(candidates(seen, "events", own + ledger.recency(F.col("index"), F.col("n")), [F.asc("sequence"), F.asc("event_id")]))
    return ledger.budget_fold(every, ["request"], budget=budget, reserved=reserved).select("used", "picked")
