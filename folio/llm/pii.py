"""Personal data: fixed patterns, and further spans by weak supervision, in DataFrame functions only.

Candidates are the fixed patterns' spans and those of looser ones. Labelers (pattern, structure,
gazetteer, context, border) vote for, against or not at all on each. The votes' patterns are
counted over the whole corpus; expectation-maximisation on those few counts gives each labeler's
reliability for each kind, and its posteriors train the logistic span classifier that decides.
Spans of the fixed patterns always stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "structure", "gazetteer", "context", "border")

# The fixed patterns, written so that each start is tried once and no repetition recurses: a run is
# entered at its start or where the last match ended, and repeated groups are possessive.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of 16 to 19 digits only: longer and shorter ones fail whole, so they needn't be listed
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\.)[A-Za-z0-9-]{1,63}){1,5}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\.)\x20?[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{3,6}(?:[\x20./-]{1,3}[0-9]{3,6}){2,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?0?[1-9][0-9]{1,4}\)?(?:[\x20./-][0-9]{2,4}){2,4}(?![0-9A-Za-z])",
}
#: A cheap look before any pattern runs.
HINT = {"email": r"@|[\[({]at[\])}]", "ip": r"[0-9]\x20?[\[(]?(?:\.|dot)", "card": r"[0-9][\x20./-]{0,3}[0-9]", "phone": r"\+[0-9]|[0-9][\x20./)-]{1,2}[0-9]"}

# Top-level domains, issuers' first digits, country codes, words near the kinds and near look-alikes.
DOMAINS = ("com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "eu", "us", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "be", "ca", "au", "jp", "br", "mx", "in")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
COUNTRIES = r"^(?:\+|00)(?:1|7|2[07]|3[0-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
NEAR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|correo|courriel|write|kontakt)\b",
    "ip": r"(?i)\b(?:ip|ipv4|host|server|address|login|from|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte|cc)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp|telefon|tel[eé]fono)\b",
}
AWAY = r"(?i)\b(?:version|v|release|section|isbn|issn|order|invoice|token|sha|hash|id|serial|part|ratio|score|date|doi)\b"
LEFT, RIGHT = 32, 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value bound once, so that what refers to it inside a lambda isn't computed again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(lengths: Column) -> Column:
    """Sums of all lengths before each entry, in k * sqrt(k) steps."""
    def by(chunk: Column) -> Column:
        many = F.ceil(F.size(lengths) / chunk).cast("int")
        total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
        sums = F.transform(F.sequence(F.lit(0), many - 1), lambda j: total(F.slice(lengths, j * chunk + 1, chunk)))

        def inner(before: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                at = F.floor(i / chunk).cast("int")
                return F.get(before, at) + total(F.slice(lengths, at * chunk + 1, i - at * chunk))
            return F.transform(lengths, one)
        return let(sums, lambda s: let(F.transform(s, lambda x, j: total(F.slice(s, F.lit(1), j))), inner))
    return let(F.ceil(F.sqrt(F.size(lengths))).cast("int"), by)


SPAN = "array<struct<start:bigint,end:bigint,text:string,left:string,right:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points and what stands next to them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def build(b: Column) -> Column:
        lengths = F.transform(b["m"], lambda x, i: (F.char_length(x) + F.char_length(F.get(b["g"], i))).cast("long"))

        def one(starts: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                gap = F.get(b["g"], i)
                start = F.get(starts, i) + F.char_length(gap)
                return F.struct(
                    start.alias("start"), (start + F.char_length(x)).alias("end"), x.alias("text"),
                    F.right(gap, F.lit(LEFT)).alias("left"), F.left(F.get(b["g"], i + 1), F.lit(RIGHT)).alias("right"),
                )
            return F.transform(b["m"], span)
        return let(lengths, lambda n: let(_starts(n), one))

    whole = let(F.struct(found.alias("m"), F.split(text, pattern, -1).alias("g")), build)
    return F.when(F.size(found) > 0, whole.cast(SPAN)).otherwise(F.array().cast(SPAN))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn test."""
    def add(s: Column, at: Column) -> Column:
        return s + at

    def total(d: Column) -> Column:
        def one(i: Column) -> Column:
            v = F.ascii(F.substring(d, -(i + 1), F.lit(1))) - 48
            return F.when(i % 2 == 1, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.char_length(d) - 1), one), F.lit(0), add)
    return let(digits(x), lambda d: F.when(F.char_length(d) > 0, total(d) % 10 == 0).otherwise(F.lit(False)))


def parts_at_most_255(x: Column) -> Column:
    """Whether every run of digits is at most 255; leading zeros don't count."""
    return F.forall(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.char_length(q) < 3) | ((F.char_length(q) == 3) & (q <= "255"))))


def _holds(kind: str, span: Column) -> Column:
    if kind == "ip":
        return parts_at_most_255(span["text"])
    if kind == "card":
        return luhn(span["text"])
    if kind == "phone":
        return F.char_length(digits(span["text"])).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The fixed pattern's spans that hold; a failing match is dropped and its text not tried again."""
    spans = F.filter(matches(text, STRICT[kind]), lambda s: _holds(kind, s))
    return F.when(text.rlike(HINT[kind]), spans).otherwise(F.array().cast(SPAN))


def other_spans(text: Column, kind: str, base: Column) -> Column:
    """Spans of the looser pattern that touch none of the base."""
    spans = F.filter(matches(text, LOOSE[kind]), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.when(text.rlike(HINT[kind]), spans).otherwise(F.array().cast(SPAN))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, s: Column, strict: bool) -> Column:
    """Each labeler's vote: 1 for, -1 against, 0 none; and a coarse length, which the classifier sees too."""
    x, n = s["text"], F.char_length(digits(s["text"]))
    if kind == "email":
        last = F.lower(F.regexp_extract(x, r"([A-Za-z0-9-]+)$", 1))
        structure, known = _vote(last.rlike("^[a-z]{2,24}$"), ~last.rlike("^[a-z]{2,24}$")), _vote(last.isin(*DOMAINS), F.lit(False))
    elif kind == "ip":
        first = F.regexp_extract(x, "^0*([0-9]+)", 1)
        structure = _vote(parts_at_most_255(x), ~parts_at_most_255(x))
        known = _vote(F.char_length(first).between(1, 3) & F.try_to_number(first, F.lit("999")).between(1, 223), F.try_to_number(first, F.lit("999")).between(0, 999))
    elif kind == "card":
        structure, known = _vote(luhn(x) & n.between(13, 19), ~luhn(x) | ~n.between(13, 19)), _vote(digits(x).rlike(ISSUERS), F.lit(True))
    else:
        structure, known = _vote(n.between(9, 13), ~n.between(8, 15)), _vote(x.rlike(COUNTRIES), F.lit(False))
    near, away = s["left"].rlike(NEAR[kind]), s["left"].rlike(AWAY)
    edge = s["left"].rlike(r"[A-Za-z0-9]$") | s["right"].rlike(r"^[A-Za-z0-9]")
    named = zip(LABELERS, (F.lit(1 if strict else 0), structure, known, _vote(near & ~away, away & ~near), _vote(F.lit(False), edge)), strict=True)
    return F.struct(*[v.cast("int").alias(k) for k, v in named], F.least(F.lit(3), F.floor(F.char_length(x) / 8)).cast("int").alias("long"))


def candidates(text: Column) -> Column:
    """All spans of all kinds: kind (its place in KINDS), start, end, base (whether a fixed pattern's), votes."""
    def told(kind: str, spans: Column, strict: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(strict).alias("base"), votes(kind, s, strict).alias("votes")))

    def of(kind: str) -> Column:
        return let(base_spans(text, kind), lambda b: F.concat(told(kind, b, True), told(kind, other_spans(text, kind, b), False)))

    return F.concat(*map(of, KINDS))


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier by kind: a bias, one for each vote of each labeler, one for each length."""

    bias: tuple[float, ...]
    weights: tuple[tuple[tuple[float, ...], ...], ...]
    lengths: tuple[tuple[float, ...], ...]
    reliability: tuple[tuple[float, ...], ...]

    def score(self, kind: Column, v: Column) -> Column:
        """Probability that a candidate is personal data."""
        def of(k: int) -> Column:
            total = F.lit(self.bias[k]) + F.get(F.array(*map(F.lit, self.lengths[k])), v["long"])
            for j, name in enumerate(LABELERS):
                total = total + F.get(F.array(*map(F.lit, self.weights[k][j])), v[name] + 1)
            return total
        z = F.when(kind == 0, of(0)).when(kind == 1, of(1)).when(kind == 2, of(2)).otherwise(of(3))
        return 1 / (1 + F.exp(-z))


def expectation_maximisation(counted: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[list[float], list[list[list[float]]]]:
    """Posteriors of vote patterns with counts, and P(vote | class) of each labeler; starts from the majority."""
    total = sum(n for _, n in counted)
    post = [1 / (1 + exp(-2.0 * sum(v))) for v, _ in counted]
    table = [[[1 / 3] * 3 for _ in range(2)] for _ in LABELERS]
    for _ in range(rounds):
        # one imagined vote each, placed as a labeler better than chance would vote
        table = [[[0.5 + (1.0 if (v - 1) == (1 if y else -1) else 0.0) for v in range(3)] for y in range(2)] for _ in LABELERS]
        share = 1.0
        for (v, n), p in zip(counted, post, strict=True):
            share += n * p
            for j, x in enumerate(v):
                table[j][1][x + 1] += n * p
                table[j][0][x + 1] += n * (1 - p)
        table = [[[c / sum(row) for c in row] for row in pair] for pair in table]
        prior = share / (total + 2.0)
        new = []
        for v, _ in counted:
            z = log(prior / (1 - prior)) + sum(log(table[j][1][x + 1] / table[j][0][x + 1]) for j, x in enumerate(v))
            new.append(1 / (1 + exp(-max(-30.0, min(30.0, z)))))
        done = max((abs(a - b) for a, b in zip(new, post, strict=True)), default=0) < 1e-6
        post = new
        if done:
            break
    return post, table


def logistic(rows: list[tuple[tuple[int, ...], int, float, float]], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3):
    """Bias, vote weights and length weights from (votes, length, target, share), by gradient descent."""
    bias, weights, lengths = 0.0, [[0.0] * 3 for _ in LABELERS], [0.0] * 4
    for _ in range(rounds):
        gb, gw, gl = 0.0, [[decay * w for w in ws] for ws in weights], [decay * w for w in lengths]
        for v, n, target, share in rows:
            z = bias + lengths[n] + sum(weights[j][x + 1] for j, x in enumerate(v))
            g = share * (1 / (1 + exp(-max(-30.0, min(30.0, z)))) - target)
            gb, gl[n] = gb + g, gl[n] + g
            for j, x in enumerate(v):
                gw[j][x + 1] += g
        bias -= rate * gb
        lengths = [w - rate * g for w, g in zip(lengths, gl, strict=True)]
        weights = [[w - rate * g for w, g in zip(ws, gs, strict=True)] for ws, gs in zip(weights, gw, strict=True)]
    return bias, weights, lengths


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep as a struct `item`, and all candidates of each text: written, so that texts are matched once. A null text has none."""
    found = candidates(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return written(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("item"), found.alias("found")), compression="zstd")


def fit(rows: DataFrame) -> Model:
    """Learns from all candidates of scanned() rows; the driver sees counts of vote patterns, at most 4 x 3^5 x 4 rows.

    A kind without a candidate, as in an empty table, gets a weight of one for each vote.
    """
    found = rows.select(F.explode("found").alias("c"))
    rows = found.select("c.kind", "c.votes.*").groupBy("kind", *LABELERS, "long").count().collect()
    bias, weights, lengths, reliability = [], [], [], []
    for k in range(len(KINDS)):
        own = sorted(((tuple(r[x] for x in LABELERS), r["long"]), r["count"]) for r in rows if r["kind"] == k)
        post, told = expectation_maximisation([(v, n) for (v, _), n in own])
        # each distinct pattern weighs by the root of its count, so that common ones don't drown the rest
        share = sum(n**0.5 for _, n in own) or 1.0
        b, w, ls = logistic([(v, n, p, c**0.5 / share) for ((v, n), c), p in zip(own, post, strict=True)])
        if not own:
            b, w = -1.0, [[-1.0, 0.0, 1.0] for _ in LABELERS]
        bias.append(b)
        weights.append(tuple(map(tuple, w)))
        lengths.append(tuple(ls))
        reliability.append(tuple(t[1][2] / (t[1][2] + t[0][2]) for t in told))
    return Model(tuple(bias), tuple(weights), tuple(lengths), tuple(reliability))


def spans(found: Column, model: Model, least: float = 0.5) -> Column:
    """Of an array of candidates those that stay, as spans: kind, start, end, base; sorted by kind, then start."""
    kept = F.filter(found, lambda c: c["base"] | (model.score(c["kind"], c["votes"]) >= least))
    return F.array_sort(F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))))


def personal_data(docs: DataFrame, model: Model | None = None, least: float = 0.5, column: str = "spans") -> DataFrame:
    """docs with an array column of spans: kind, start, end (code points, end exclusive), base; sorted by kind, then start.

    Candidates of fixed patterns always stay; others stay from `least` on, by a model that is
    learned from docs if none is given. A null or empty text has none; very long texts are matched
    whole. Rows, repeated ones too, and other columns stay as they are, whatever their names; a
    column of the name given is replaced. Spans of one kind never overlap; those of different kinds
    may. An empty table gives an empty result.
    """
    rows = scanned(docs, docs.columns)
    own = [F.col(f"item.`{c}`").alias(c) for c in docs.columns if c != column]
    return rows.select(*own, spans(F.col("found"), model or fit(rows), least).alias(column))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; of overlapping spans, the first names the place."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["back"]
        piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.get(names, s["kind"]))
        return F.when(s["start"] >= acc["at"], F.struct(piece.alias("out"), end.alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], end).alias("at")))

    done = F.aggregate(order, state, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in their texts; n_chars, if there, follows the text.

    Null texts stay null, texts without personal data as they are; no row goes, and other columns
    stay, whatever their names. An empty table gives an empty result.
    """
    rows = scanned(docs, docs.columns)
    out = rows.select("item", masked(F.col("item.text").cast("string"), spans(F.col("found"), fit(rows))).alias("masked"))
    changed = {"text": F.col("masked"), "n_chars": F.char_length("masked").cast("long")}
    return out.select(*[changed.get(c, F.col(f"item.`{c}`")).alias(c) for c in docs.columns])


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"), ["doc_id"])
    rows = found.select("item.doc_id", spans(F.col("found"), fit(found)).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
