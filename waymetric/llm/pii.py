"""Operator 13: personal data by weak supervision, in built-in expressions only.

Strict patterns find the base spans, wide ones further candidates (written-out or
bracketed mail addresses, numbers without a plus sign, numbers with other separators).
Five labelers vote on every candidate or abstain: the strict pattern, a check of the
digits, a gazetteer, the words in front, and what the span touches.  Votes are counted
by pattern over all documents; expectation-maximisation over that bounded table
estimates each labeler's reliability by kind, without labels.  The probabilities that
follow are the labels on which a span classifier is trained, over features that are not
the votes: digits, length, separators, neighbouring characters and words.  Wide
candidates that the classifier accepts join the base spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, discard, materialise

KINDS = ("email", "ip", "card", "phone")
#: (kind, wide, what a text must have to be searched, pattern).  Quantifiers take all they can and never give back, and
#: matches start where a run of their characters starts, so that the time is linear and no stack grows with a match.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_AT, _DOT = r"(?:\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)", r"(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20)"
SOURCES = (
    ("email", False, "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    ("ip", False, ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    # maximal runs of digits with single separators, 12 to 19 digits
    ("card", False, None, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"),
    ("phone", False, "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", True, ("dot", "DOT"), rf"(?<!{_LOCAL}){_LOCAL}++{_AT}{_LABEL}++(?:(?:{_DOT}|\.){_LABEL}++){{0,8}}?{_DOT}{_LABEL}++(?:(?:{_DOT}|\.){_LABEL}++)*+"),
    ("ip", True, "[.]", r"(?<![0-9])[0-9]++(?:\[\.\][0-9]++){3}"),
    ("card", True, None, r"(?<![0-9])[0-9]{4}([._/\u2010-\u2014\u00A0])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    # (555) 123-4567, 555-123-4567, 0049 30 1234 5678, not within longer runs of numbers
    (
        "phone", True, None,
        r"(?<![0-9A-Za-z+.,_/-])(?<![0-9+][\x20(])(?:\([0-9]{2,4}\)[\x20-]?[0-9]{3,4}[\x20-][0-9]{3,4}|[0-9]{3}([-.\x20])[0-9]{3}\1[0-9]{4}|00[1-9][0-9]{0,2}(?:[\x20-]?[0-9]{2,4}){3,4}+)"
        r"(?![\x20.-]?[0-9])(?![A-Za-z_])",
    ),
)

# Gazetteers and words that speak for and against a kind.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "uk", "us", "de", "at", "ch", "fr", "be", "es", "mx", "ar", "pe", "it", "nl", "pl", "pt", "br", "jp", "cn", "in", "au", "ca")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "81", "82", "86", "91", "351")
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[0478]|6(?:011|[245]))"
CUES = {
    "email": "mail|correo|courriel|contact|schreib|write to|reach",
    "ip": r"\bip\b|server|host|client|login|logged|adress|address|direcci",
    "card": "card|visa|mastercard|amex|tarjeta|carte|karte|konto|cuenta|compte|pay",
    "phone": r"phone|tel\b|tel\.|call|mobil|cell|fax|whatsapp|sms|telefon|teléfono|téléphone|llam|appel|anruf",
}
AGAINST = r"isbn|issn|order|invoice|version|\bv\.?$|build|\brev|page|\bsku|serial|\bid\b|ticket|pedido|factura|commande|rechnung|bestell|hash|token|key"
LABELERS = ("strict", "check", "gazetteer", "words", "edges")
#: Rounds of expectation-maximisation, the weight of what is believed before any vote, and log odds from which a wide candidate is accepted.
ROUNDS, PRIOR, ACCEPT = 12, 1.0, math.log(9)
#: Buckets of the words around a span; a feature's counts grow with the corpus, their number doesn't.
BUCKETS = 4096


def _found(text: Column, needs: str | tuple[str, ...] | None, pattern: str) -> Column:
    """(gap, n, match, left, right) of the matches in order: code points since the last one, own length, text, and what surrounds it."""
    p = F.lit(pattern)
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    zipped = F.arrays_zip(pieces.alias("piece"), found.alias("match"), F.slice(pieces, 2, 1 << 30).alias("next"))
    one = lambda z: F.struct(
        F.length(z["piece"]).alias("gap"), F.length(z["match"]).alias("n"), z["match"].alias("match"), F.substring(z["piece"], -40, 40).alias("left"), F.substring(z["next"], 1, 20).alias("right")
    )
    has = text.rlike(pattern)
    if needs:
        plain = [F.contains(text, F.lit(x)) for x in ((needs,) if isinstance(needs, str) else needs)]
        any_of = plain[0]
        for x in plain[1:]:
            any_of = any_of | x
        has = any_of & has
    return F.when(has, F.transform(F.filter(zipped, lambda z: z["match"].isNotNull()), one))


def candidates(df: DataFrame | Rows, id_col: str, text_col: str) -> DataFrame:
    """(row, id, kind, wide, start, end, match, left, right) of every match of every source; one row without kind where a text has none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = Rows.of(df).select(id=F.col(id_col).cast("long"), text=text)
    tagged = lambda s: lambda m: F.struct(F.lit(s).alias("source"), m.alias("m"))
    lists = [F.transform(_found(F.col("text"), n, p), tagged(s)) for s, (_, _, n, p) in enumerate(SOURCES)]
    empty = F.array().cast("array<struct<source:int,m:struct<gap:int,n:int,match:string,left:string,right:string>>>")
    every = rows.select("row", "id", F.posexplode_outer(F.concat(*[F.coalesce(x, empty) for x in lists])).alias("i", "c"))
    of_text = Window.partitionBy("row", "c.source").orderBy("i")
    start = F.sum(F.col("c.m.gap").cast("long")).over(of_text) + F.coalesce(F.sum(F.col("c.m.n").cast("long")).over(of_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("c.source") + 1)
    placed = every.repartition("row").select("row", "id", "c", start.alias("start"))
    return placed.select("row", "id", at([s[0] for s in SOURCES]).alias("kind"), at([s[1] for s in SOURCES]).alias("wide"), "start", (F.col("start") + F.col("c.m.n")).alias("end"), "c.m.match", "c.m.left", "c.m.right")


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def in_bytes(match: Column) -> Column:
    """Whether all numbers of an address are at most 255."""
    parts = F.transform(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0)), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) < 4) & (F.substring(p, 1, 3).try_cast("int") <= 255))


def by_kind(kind: Column, **columns: Column) -> Column:
    out = F
    for k, c in columns.items():
        out = out.when(kind == k, c)
    return out


def passes(kind: Column, match: Column) -> Column:
    """Whether a match of a strict pattern is a base span."""
    digits = digits_of(match)
    return by_kind(
        kind, email=F.lit(True), ip=in_bytes(match), card=F.length(digits).between(12, 19) & F.call_function("luhn_check", digits), phone=F.length(digits).between(9, 15)
    )


def votes(found: DataFrame) -> DataFrame:
    """Adds base, and v: the votes of the LABELERS, 1 for, -1 against, 0 abstains."""
    kind, match = F.col("kind"), F.col("match")
    digits = digits_of(match)
    vote = lambda for_, against: F.when(for_, 1).when(against, -1).otherwise(0)
    end = F.lower(F.regexp_extract(match, "([A-Za-z0-9-]+)$", 1))
    first = F.regexp_extract(match, "^[0-9]{1,3}", 0).try_cast("int")
    luhn = F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    known = F.lit(False)
    for c in CALLING:
        known = known | digits.startswith(c) | digits.startswith("00" + c)
    ok = ~F.col("wide") & passes(kind, match)
    left, near = F.lower("left"), F.lower(F.substring("left", -24, 24))
    cue = by_kind(kind, **{k: left.rlike(v) for k, v in CUES.items()})
    before, after = F.substring("left", -1, 1), F.substring("right", 1, 1)
    glued = before.rlike(r'[A-Za-z0-9_"=#/\\]') | after.rlike(r'[A-Za-z0-9_"/\\]')
    check = by_kind(kind, email=end.rlike("^[a-z]{2,24}$"), ip=in_bytes(match), card=luhn, phone=F.length(digits).between(10, 14))
    listed = by_kind(kind, email=end.isin(*DOMAINS), ip=first.between(1, 223) & (first != 127), card=digits.rlike(ISSUERS), phone=known & (match.startswith("+") | match.startswith("00")))
    unlisted = by_kind(kind, email=F.col("wide") & ~end.isin(*DOMAINS), ip=(first == 0) | (first == 127) | (first >= 240), card=~digits.rlike(ISSUERS), phone=F.lit(False))
    v = F.array(vote(ok, ~F.col("wide") & ~ok), vote(check, ~check), vote(listed, unlisted), vote(cue & ~near.rlike(AGAINST), near.rlike(AGAINST)), vote(~glued, glued))
    return found.withColumns({"base": F.coalesce(ok, F.lit(False)), "v": v})


def _logit(v: Column, kind: Column, prior: dict[str, float], odds: dict[str, float]) -> Column:
    """Log odds of a candidate under the labelers' log odds by kind, labeler and vote; a labeler that abstains says nothing."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    said = F.transform(v, lambda x, j: F.coalesce(F.element_at(table(odds), F.concat_ws("|", kind, j.cast("string"), x.cast("string"))), F.lit(0.0)))
    return F.coalesce(F.element_at(table(prior), kind), F.lit(0.0)) + F.aggregate(said, F.lit(0.0), lambda a, b: a + b)


def _chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))


def reliabilities(counted: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[dict[str, float], dict[str, float]]:
    """(log odds of each kind, log odds of each "kind|labeler|vote") by expectation-maximisation over (kind, v, n), from the majority of votes.

    counted has at most a row for each kind and pattern of votes; each round brings a sum
    for each kind, labeler and vote to the driver.
    """
    chance = _chance(2.0 * F.aggregate("v", F.lit(0.0), lambda a, b: a + b))
    odds: dict[str, float] = {}
    before: dict[str, float] = {}
    for _ in range(rounds):
        each = counted.select("kind", "n", chance.alias("p"), F.posexplode("v").alias("j", "vote")).groupBy("kind", "j", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum("n").alias("n"))
        sums = {(r["kind"], r["j"], r["vote"]): (r["yes"], r["n"] - r["yes"]) for r in each.collect()}
        for kind in {k for k, _, _ in sums}:
            all_yes, all_no = (sum(x[c] for (k, j, _), x in sums.items() if k == kind and j == 0) for c in (0, 1))
            before[kind] = math.log((all_yes + prior) / (all_no + prior))
            for j in range(len(LABELERS)):
                # believed before: a vote is right three times in four
                yes, no = ({x: sums.get((kind, j, x), (0.0, 0.0))[c] + prior * (3 if (x > 0) == (c == 0) else 1) for x in (1, -1)} for c in (0, 1))
                for x in (1, -1):
                    odds[f"{kind}|{j}|{x}"] = math.log(yes[x] / (yes[1] + yes[-1])) - math.log(no[x] / (no[1] + no[-1]))
        chance = _chance(_logit(F.col("v"), F.col("kind"), before, odds))
    return before, odds


def features() -> Column:
    """The features of a candidate as 64-bit numbers: digits, length, separators, what it touches, words around."""
    match, digits = F.col("match"), digits_of(F.col("match"))
    touch = lambda c: F.when(c == "", "").when(c.rlike("[0-9]"), "9").when(c.rlike("[A-Za-z]"), "a").when(c.rlike(r"\s"), " ").otherwise(c)
    word = lambda c, p: F.pmod(F.xxhash64(F.lower(F.regexp_extract(c, p, 1))), F.lit(BUCKETS)).cast("string")
    named = {
        "digits": F.least(F.length(digits), F.lit(24)).cast("string"), "length": F.least((F.length(match) / 4).cast("int"), F.lit(20)).cast("string"),
        "separators": F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(match, "[A-Za-z0-9]", ""), ""))), ""), "before": touch(F.substring("left", -1, 1)), "after": touch(F.substring("right", 1, 1)),
        "end": F.when(F.col("kind") == "email", F.lower(F.regexp_extract(match, "([A-Za-z0-9-]+)$", 1))).otherwise(F.substring(digits, 1, 2)),
        "word": word(F.col("left"), r"(\p{L}+)\P{L}*$"), "next": word(F.col("right"), r"^\P{L}*(\p{L}+)"),
    }
    return F.array(*[F.xxhash64("kind", F.lit(name), c) for name, c in named.items()])


def classifier(labelled: DataFrame, prior: float = 4.0) -> DataFrame:
    """(f, weight, prior): naive Bayes log odds of each feature from (kind, p, features), drawn towards none where counts are small, and of its kind."""
    sums = labelled.select("kind", "p", F.explode("features").alias("f")).groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    whole = labelled.groupBy("kind").agg(F.sum("p").alias("all_yes"), F.sum(1 - F.col("p")).alias("all_no"))  # a row for each kind
    share = (F.col("all_yes") + 1) / (F.col("all_yes") + F.col("all_no") + 2)
    weight = F.log((F.col("yes") + prior * share) / (F.col("no") + prior * (1 - share))) - F.log(share / (1 - share))
    return sums.join(whole, "kind").select("f", weight.alias("weight"), F.log(share / (1 - share)).alias("prior"))


def find_personal_data(df: DataFrame | Rows, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points of the whole text, by start, then kind in
    the order of KINDS.  Base spans are the strict matches that pass their check; n_* and
    base_sha256 tell of these alone.  spans has them and the wide candidates that the
    classifier accepts and that overlap no base span, the earlier and longer first.  Null
    and empty texts have none (the digest of nothing, an empty string).  Repeated rows and
    ids each get their row; extra columns are ignored; an empty table gives no rows.  A
    text takes one row with its matches, each of them a row then: time is linear in the
    text.  Statistics are over all candidates of the table.
    """
    found = materialise(votes(candidates(df, id_col, text_col)).withColumn("features", F.when(F.col("kind").isNotNull(), features())), "pii-candidates")
    accepted = accept(found.where("kind is not null"))
    key = ["row", "kind", "start", "end"]
    marked = found.select(*key, "id", "base").join(accepted.withColumn("wide", F.lit(True)), key, "left")
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("base"), "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    clear = F.col("wide") & (F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(before), F.lit(0)) <= F.col("start"))
    clear = clear & F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after) >= F.col("end"), F.lit(True))
    marked = marked.withColumn("clear", F.coalesce(clear, F.lit(False)))
    first = F.coalesce(F.max(F.when(F.col("clear"), F.col("end"))).over(before) <= F.col("start"), F.lit(True))
    marked = marked.withColumn("added", F.col("clear") & first)
    rank = by_kind(F.col("kind"), **{k: F.lit(i) for i, k in enumerate(KINDS)})
    span = F.struct("start", rank.alias("rank"), F.col("end").alias("end"), "kind")
    joined = lambda which: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(which, span))), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return marked.groupBy("row").agg(
        F.any_value("id").alias(id_col), *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("base") | F.col("added")).alias("spans")
    ).drop("row")


def accept(real: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the wide candidates that the trained classifier accepts; real: all candidates with their votes and features."""
    counted = materialise(real.groupBy("kind", "v").agg(F.count(F.lit(1)).alias("n")), "pii-votes")
    prior, odds = reliabilities(counted)
    discard(counted)
    key = ["row", "kind", "start", "end"]
    if not prior:
        return real.select(*key)  # none
    labelled = real.select("kind", "features", _chance(_logit(F.col("v"), F.col("kind"), prior, odds)).alias("p"))
    weights = materialise(classifier(labelled), "pii-weights")
    scored = real.where("wide").select(*key, F.explode("features").alias("f")).join(weights, "f").groupBy(*key).agg((F.sum("weight") + F.max("prior")).alias("score"))
    accepted = materialise(scored.where(F.col("score") > ACCEPT).select(*key), "pii-accepted")
    discard(weights)
    return accepted
