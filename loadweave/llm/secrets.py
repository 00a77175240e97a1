"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query of trigrams (``trigrams``). The
index holds a posting (trigram, row key) for every trigram that some query needs;
postings of a clause are intersected by counting them per row key, clauses are united.
Rules run only on the rows that their query finds; a rule without mandatory trigrams
runs on all. The index only spares work: every span comes from the rule itself.

Spans are leftmost, non-overlapping matches per rule, in code points, end exclusive;
matches that miss the rule's length are dropped after matching, so they still use up
their text. A null text is empty. Rows are scanned one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import let
from loadweave.llm.trigrams import trigram_query
from loadweave.session import pin


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 0
    base: bool = False


RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    # as [0-9a-f]+ of which shorter matches are dropped: a match is a whole run
    Rule("hex", r"[0-9a-f]{24,}", least=24, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


_AT_ONCE = 256
_SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def _row_key() -> Column:
    # equal rows share a key; rows that share one by chance are only scanned needlessly
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index: trigram, key of a row whose folded text contains it."""
    literals = F.array(*[F.lit(t) for t in wanted])
    found = let(
        F.lower("text"), lambda text: F.filter(literals, lambda t: F.contains(text, t))
    )
    return docs.filter(F.col("text").isNotNull()).select(
        F.explode(found).alias("trigram"), _row_key().alias("key")
    )


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """key, rules: a bit for each rule whose trigram query the row satisfies."""
    clauses = [
        (bit, trigrams)
        for bit, rule in enumerate(rules)
        for trigrams in sorted(map(sorted, trigram_query(rule.pattern)))
        if trigrams
    ]
    spark = docs.sparkSession
    # as many rows as the rules have trigrams
    asked = spark.createDataFrame(
        [(n, bit, len(ts), t) for n, (bit, ts) in enumerate(clauses) for t in ts],
        "clause int, rule int, size int, trigram string",
    )
    index = postings(docs, sorted({t for _, ts in clauses for t in ts})).distinct()
    met = index.join(F.broadcast(asked), "trigram").groupBy("key", "clause", "rule", "size").count()
    return (
        met.filter(F.col("count") == F.col("size"))
        .groupBy("key")
        .agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("rules"))
    )


def _placed(sized: Column, rule: Rule, order: int) -> Column:
    """Spans of matches, given for each the gap before it, its size and the length that counts.

    Places are running sums. A fold copies what it has gathered with every match, so it runs over
    ``_AT_ONCE`` matches at a time, from 0, and the sums of the parts move the spans.
    """

    def step(s, x):
        start = s["at"] + x["gap"]
        span = F.struct(
            start.alias("start"),
            F.lit(order).alias("order"),
            (start + x["size"]).alias("end"),
            F.lit(rule.kind).alias("kind"),
        )
        kept = F.when(x["counted"] >= rule.least, F.array(span)).otherwise(F.array().cast(_SPANS))
        return F.struct((start + x["size"]).alias("at"), F.concat(s["spans"], kept).alias("spans"))

    def folded(c):
        none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
        return F.aggregate(F.slice(sized, c * _AT_ONCE + 1, F.lit(_AT_ONCE)), none, step)

    def moved(parts):
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(
            parts,
            none,
            lambda s, p: F.struct(
                (s["at"] + p["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")
            ),
            lambda s: s["starts"],
        )

        def span(x, by):
            return F.struct(
                (x["start"] + by).alias("start"), x["order"].alias("order"), (x["end"] + by).alias("end"), x["kind"].alias("kind")
            )

        return let(
            starts,
            lambda by: F.flatten(
                F.transform(parts, lambda p, i: F.transform(p["spans"], lambda x: span(x, F.get(by, i))))
            ),
        )

    last = F.floor((F.greatest(F.size(sized), F.lit(1)) - 1) / _AT_ONCE).cast("int")
    return let(F.transform(F.sequence(F.lit(0), last), folded), moved)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Sorted structs (start, order, end, kind) of the rule's matches in a text."""
    pattern = F.lit(rule.pattern)

    def found(matches, counted):
        pieces = F.split(text, rule.pattern, -1)
        sized = let(
            F.struct(pieces.alias("p"), counted.alias("c")),
            lambda x: F.transform(
                matches,
                lambda m, i: F.struct(
                    F.length(F.get(x["p"], i)).alias("gap"),
                    F.length(m).alias("size"),
                    F.length(F.get(x["c"], i)).alias("counted"),
                ),
            ),
        )
        return let(sized, lambda sized: _placed(sized, rule, order))

    spans = let(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda matches: found(
            matches,
            F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches,
        ),
    )
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(_SPANS))


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and ``spans``: all spans of a row, by start, then rule."""
    found = pin(candidates(docs, rules))
    rows = docs.select("doc_id", "text", _row_key().alias("key")).join(
        found.hint("merge"),  # candidates grow with the documents: one plan for all sizes
        "key",
        "left",
    )
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_rule(order, rule):
        spans = _spans(F.col("t"), rule, order)
        if frozenset() in trigram_query(rule.pattern):
            return spans
        asked = F.coalesce(F.getbit("rules", F.lit(order)), F.lit(0)) == 1
        return F.when(asked, spans).otherwise(F.array().cast(_SPANS))

    every = F.concat(*[of_rule(order, rule) for order, rule in enumerate(rules)])
    return rows.select("doc_id", "rules", text.alias("t")).select(
        "doc_id", F.sort_array(every).alias("spans")
    )


def secret_report(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, matches per base rule, SHA-256 of the base spans, and all spans."""
    base = [r.kind for r in rules if r.base]

    def of(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    found = scan(docs, rules).select(
        "doc_id", "spans", F.filter("spans", lambda s: s["kind"].isin(base)).alias("base")
    )
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
