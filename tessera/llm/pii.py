"""Personal data by weak supervision, in DataFrame functions throughout.

Candidates are the matches of rules: email, ip, card and phone, whose valid
matches are always spans, and looser rules that only propose.  Labelers (the
strict rules, shape checks, context words, gazetteers, the surroundings) vote on
each candidate.  Votes are counted by pattern, of which there is a fixed number;
expectation-maximisation over those counts estimates how reliable each labeler
is, and the posteriors train a naive Bayes span classifier on votes, kind and
length.  Proposed candidates that it accepts become spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table

# \G or no word character of the same run before: a run is tried from its start only.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    # only runs of at least 13 digits can be cards
    "card": r"[0-9](?=(?:[\x20-]?[0-9]){12})(?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "email_like": r"(?i)[a-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[a-z0-9-]+(?:\x20?(?:\.|[\[(]dot[\])])\x20?[a-z0-9-]+)+",
    "phone_like": r"(?<![0-9+(.\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?![A-Za-z0-9])",
    "secret": r"[A-Za-z_]{1,40}\x20?[=:]\x20?\"[0-9A-Za-z_/+=-]{16,}\"",
}
KINDS = [*RULES, *PROPOSED]

_GUARD: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
    "email_like": lambda t: t.rlike(r"(?i)[\[(]at[\])]"),
    "phone_like": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    "account": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[0-9A-Z]{4}"),
    "secret": lambda t: t.contains('"'),
}

#: Words shortly before a span that speak for its kind.
CONTEXT = {"email": "mail|contact|write|from|to:", "ip": r"\bip\b|host|server|address|from", "card": "card|visa|master|pay|credit",
           "phone": "phone|tel|call|mobile|fax|cell|whats", "account": "iban|account|bank|konto", "secret": "key|token|secret|pass|pwd|auth"}
_CONTEXT_OF = {"email_like": "email", "phone_like": "phone"}
#: Top-level domains, calling codes, first digits of card issuers, names of secrets.
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl", "us", "ca", "au"]
CALLING = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
           "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92"]
ISSUERS = ["2", "3", "4", "5", "6"]
SECRETS = ["key", "apikey", "api_key", "token", "secret", "password", "passwd", "pwd", "access_key", "auth"]
LABELERS = ("rule", "shape", "context", "gazetteer", "surroundings")
BEFORE = 24
ACCEPT = 0.5


#: Hits whose positions are summed up together.
CHUNK = 128


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with value computed once a row: as a lambda's variable it is not
    written out at every use."""
    return F.element_at(F.transform(F.array(value), of), 1)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.reverse(x)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), F.lit(0), lambda s, i: s + _luhn_digit(d, i))
    return total % 10 == 0


def _luhn_digit(d: Column, i: Column) -> Column:
    n = F.coalesce(d.substr(i, F.lit(1)).try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1)
    return F.when(n > 9, n - 9).otherwise(n)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)") <= 255, F.regexp_replace(p, "^0+", "") == "")),
    "card": lambda x: F.length(digits(x)).between(13, 19) & luhn(digits(x)),
    "phone": lambda x: F.length(digits(x)).between(9, 15),
}


def found(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, text, before, after>>: the leftmost
    non-overlapping matches.  Starts (code points) are summed up from the text
    between the matches."""
    rule = (RULES | PROPOSED)[kind]
    # A hit starts behind the gaps and hits before it.  Sums, and the text around hits,
    # are taken in slices of CHUNK hits, so the work grows in proportion to the hits
    # and the text; a slice's own text has the ends of its gaps only.
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    part = lambda x, k: F.slice(x, k * CHUNK + 1, F.lit(CHUNK))
    tail = lambda x: F.right(x, F.lit(BEFORE))

    def pieces(x: Column) -> Column:
        """Slice by slice: hits, gaps, the widths of both, the ends of gaps, their text."""
        count = F.greatest(F.ceil(F.size(x["hits"]) / CHUNK).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: bound(
            F.struct(part(x["hits"], k).alias("hits"), part(x["gaps"], k).alias("gaps")),
            lambda y: bound(F.transform(y["hits"], lambda h, i: F.struct(F.get(y["gaps"], i).alias("gap"), h.alias("hit"))),
                            lambda z: F.struct(
                                z.alias("z"),
                                F.transform(z, lambda v: F.length(v["gap"]) + F.length(v["hit"])).alias("wide"),
                                F.transform(z, lambda v: F.length(tail(v["gap"])) + F.length(v["hit"])).alias("near"),
                                F.array_join(F.transform(z, lambda v: F.concat(tail(v["gap"]), v["hit"])), "").alias("text")))))

    def spots_of(x: Column) -> Column:
        """x: gaps, hits, slices and the slices' widths."""
        return F.flatten(F.transform(x["slices"], lambda y, k: bound(
            F.struct(total(F.slice(x["sums"], F.lit(1), k)).alias("at"), tail(F.coalesce(F.get(x["slices"], k - 1)["text"], F.lit(""))).alias("lead"), y.alias("y")),
            lambda w: bound(F.concat(w["lead"], w["y"]["text"]), lambda around: F.transform(w["y"]["z"], lambda v, i: bound(
                F.struct((total(F.slice(w["y"]["wide"], F.lit(1), i)) + F.length(v["gap"])).alias("wide"),
                         (F.length(w["lead"]) + total(F.slice(w["y"]["near"], F.lit(1), i)) + F.length(tail(v["gap"]))).alias("near"),
                         (k * CHUNK + i + 1).alias("next")),
                lambda n: F.struct(
                    (w["at"] + n["wide"]).alias("start"), v["hit"].alias("text"),
                    around.substr(F.greatest(n["near"] - BEFORE, F.lit(0)) + 1, F.least(n["near"], F.lit(BEFORE))).alias("before"),
                    F.left(F.concat(F.coalesce(F.get(x["gaps"], n["next"]), F.lit("")), F.coalesce(F.get(x["hits"], n["next"]), F.lit(""))),
                           F.lit(1)).alias("after"))))))))

    read = F.struct(F.split(text, rule, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(rule), F.lit(0)).alias("hits"))
    spots = bound(read, lambda x: bound(pieces(x), lambda p: bound(
        F.struct(x["gaps"].alias("gaps"), x["hits"].alias("hits"), p.alias("slices"), F.transform(p, lambda y: total(y["wide"])).alias("sums")), spots_of)))
    if kind in VALID:
        spots = F.filter(spots, lambda s: VALID[kind](s["text"]))
    full = F.transform(spots, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["text"])).alias("end"), s["text"].alias("text"),
        s["before"].alias("before"), s["after"].alias("after")))
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int,text:string,before:string,after:string>>")
    return F.when(_GUARD[kind](text), full).otherwise(none)


def votes(c: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 for, 0 against, -1 none."""
    kind, text, yes, no, none = c["kind"], c["text"], F.lit(1), F.lit(0), F.lit(-1)
    flag = lambda b: F.when(b, yes).otherwise(no)
    d = digits(text)
    domain = F.lower(F.element_at(F.split(text, r"\."), -1))
    octet = F.coalesce(F.element_at(F.split(text, r"\."), 1).try_cast("int"), F.lit(0))
    name = F.lower(F.regexp_extract(text, r"^([A-Za-z_]+)", 1))
    shape = (F.when(kind == "email", flag(F.length(domain).between(2, 6))).when(kind == "ip", flag(octet.between(1, 223)))
             .when(kind == "card", flag(F.length(d) == 16)).when(kind == "phone", flag(F.length(d) >= 10))
             .when(kind == "phone_like", F.when(text.contains("("), yes).otherwise(none))
             .when(kind == "account", flag(F.length(d) >= 12))
             .when(kind == "secret", flag(F.regexp_extract(text, '"(.*)"', 1).rlike("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"))).otherwise(none))
    near = F.lower(F.concat(F.coalesce(c["before"], F.lit("")), F.when(kind == "secret", text).otherwise("")))
    context = none
    for k in KINDS:
        context = F.when((kind == k) & near.rlike(CONTEXT[_CONTEXT_OF.get(k, k)]), yes).otherwise(context)
    gazetteer = (F.when(kind.isin("email", "email_like"), flag(domain.isin(DOMAINS))).when(kind == "card", flag(d.substr(1, 1).isin(ISSUERS)))
                 .when(kind == "phone", flag(d.substr(1, 1).isin(CALLING) | d.substr(1, 2).isin(CALLING)))
                 .when(kind == "ip", flag(~octet.isin(0, 10, 127, 255))).when(kind == "secret", flag(name.isin(SECRETS))).otherwise(none))
    inside = F.coalesce(c["before"], F.lit("")).rlike("[A-Za-z0-9_]$") | F.coalesce(c["after"], F.lit("")).rlike("^[A-Za-z0-9_]")
    return {"rule": F.when(kind.isin(*RULES), yes).otherwise(none), "shape": shape, "context": context, "gazetteer": gazetteer,
            "surroundings": F.when(inside, no).otherwise(none)}


def length_step(c: Column) -> Column:
    return F.least((c["end"] - c["start"]) / 8, F.lit(6)).cast("int")


def reliabilities(patterns: list[dict], rounds: int = 60) -> tuple[list[float], dict[str, float]]:
    """Expectation-maximisation over counted vote patterns (kind, votes, n).
    Adds ``p`` (posterior of personal data) to each pattern; returns each
    labeler's reliability and each kind's rate.  Labelers are taken to be right
    more often than not, counts are smoothed by one vote either way."""
    right = {v: 0.8 for v in LABELERS}
    rate = {r["kind"]: 0.7 for r in patterns}
    for _ in range(rounds):
        for r in patterns:
            z = math.log(rate[r["kind"]] / (1 - rate[r["kind"]]))
            for v in LABELERS:
                if r[v] >= 0:
                    z += math.log(right[v] / (1 - right[v])) * (1 if r[v] else -1)
            r["p"] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        for v in LABELERS:
            cast = [r for r in patterns if r[v] >= 0]
            good = sum(r["n"] * (r["p"] if r[v] else 1 - r["p"]) for r in cast)
            right[v] = min(0.99, max(0.55, (good + 4) / (sum(r["n"] for r in cast) + 5)))
        for k in rate:
            own = [r for r in patterns if r["kind"] == k]
            rate[k] = min(0.98, max(0.02, (sum(r["n"] * r["p"] for r in own) + 1) / (sum(r["n"] for r in own) + 2)))
    return [right[v] for v in LABELERS], rate


def span_classifier(patterns: list[dict]) -> Callable[[Column], Column]:
    """Naive Bayes on kind, votes and length, trained on the patterns' posteriors;
    gives the probability of a candidate."""
    yes, no = sum(r["n"] * r["p"] for r in patterns), sum(r["n"] * (1 - r["p"]) for r in patterns)
    prior = math.log((yes + 1) / (no + 1))
    tables: dict[str, dict] = {}
    for name in ("kind", "step", *LABELERS):
        values = sorted({r[name] for r in patterns})
        tables[name] = {x: math.log((sum(r["n"] * r["p"] for r in patterns if r[name] == x) + 0.5) / (yes + 0.5 * len(values)))
                        - math.log((sum(r["n"] * (1 - r["p"]) for r in patterns if r[name] == x) + 0.5) / (no + 0.5 * len(values)))
                        for x in values}

    def probability(c: Column) -> Column:
        z = F.lit(prior)
        for name, col in {"kind": c["kind"], "step": length_step(c), **votes(c)}.items():
            w = F.lit(0.0)
            for x, v in tables[name].items():
                w = F.when(col == F.lit(x), F.lit(v)).otherwise(w)
            z = z + w
        return 1 / (1 + F.exp(-z))

    return probability


def find_personal_data(spark: SparkSession, docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, base and added spans of every whole text.

    docs: doc_id, text (other columns are ignored).  Returns doc_id, base
    array<struct<kind, start, end, ...>> (valid rule matches, by kind as in
    RULES, then start), added (proposed spans that the classifier accepts and
    that touch no base span, likewise).  Null and empty texts have no spans;
    repeated rows and null ids are kept as they are.  Without candidates, or in
    an empty table, nothing is learned or added."""
    scratch = Scratch(spark, "pii")
    text = F.coalesce(F.col("body"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("body"))
    seen = scratch.write(slim.select("doc_id", F.concat(*[found(text, k) for k in RULES]).alias("base"),
                                     F.concat(*[found(text, k) for k in PROPOSED]).alias("proposed")), "candidates")
    seen = seen.withColumn("proposed", F.filter("proposed", lambda c: ~F.exists(
        "base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
    each = seen.select(F.explode(F.concat("base", "proposed")).alias("c"))
    patterns = [r.asDict() for r in each.select(F.col("c.kind").alias("kind"), length_step(F.col("c")).alias("step"),
                                                 *[v.alias(k) for k, v in votes(F.col("c")).items()])
                .groupBy("kind", "step", *LABELERS).agg(F.count("*").alias("n")).orderBy("kind", "step", *LABELERS).collect()]
    reliabilities(patterns)
    probability = span_classifier(patterns) if patterns else lambda c: F.lit(0.0)
    return seen.select("doc_id", "base", F.filter("proposed", lambda c: probability(c) >= accept).alias("added"))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(spark, table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in RULES]
    return out.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                      span_text(F.concat("base", "added")).alias("spans"))
