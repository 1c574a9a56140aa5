"""Personal data: high-recall candidates, boosted trees, calibrated thresholds (operator 9).  DataFrame functions only.

Four base kinds (email, ip, card, phone) are patterns with a check each; every match that passes is a span.  High-
recall generators propose further spans, which may overlap: written-out mail addresses, account numbers, national
ids, local phone numbers and secrets.  A candidate is described by its format (length, shares of digits, letters and
different characters, case, separators) and by its context (words of its kind before it, an assignment, a quote); a
sum of depth-two trees scores it, and a threshold per kind, set for precision on held-out examples, selects it.

The trees are fitted by gradient boosting on the logistic loss over SAMPLE examples that SQL expressions write from
public formats, positive and negative, and that pass through the same generators and features; the driver sees one
row per combination of features.  Whole formats are held out: on these the scores of each kind are calibrated to
probabilities (Platt's logistic fit with smoothed targets), and a candidate is selected from a probability of SELECT on.
`held_out` tells precision and recall there.  The model becomes a CASE expression.  Spans are in code points, end exclusive.

Positions need no engine support: the text split at the matches gives the lengths between them.  They are summed in
steps of STEP matches and the steps then shifted, so that many matches in one text are not copied over and over.

Edge cases: a null text counts as empty (no span); texts of any length are searched whole: patterns start only where
a run of their characters starts and never give back, so long runs cost linear time; repeated rows give repeated
rows; an empty table gives an empty table; other columns are carried, but one named like the result (`out`) is replaced by
it (names that begin with two underscores are reserved).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 2400
SELECT = 0.5
STEP = 128
BASE = ("email", "ip", "card", "phone")
#: Start-of-run conditions keep the search linear; \G lets a match begin where the last one ended, as a plain search does.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_written": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone_local": r"(?<![0-9+().-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
ADDED = tuple(k for k in PATTERNS if k not in BASE)
CONTEXT = {
    "email_written": "mail|contact|write|address",
    "account": "iban|account|bank|konto|cuenta|compte",
    "national_id": "ssn|social|security|passport|id",
    "phone_local": "phone|tel|call|mobile|cell|fax",
    "secret": "token|key|secret|passw|auth|bearer|credential",
}
NEED = {"email": "@", "phone": "+"}  # a character without which there is no match
RUN = {"email_written": r"[(\[]at[)\]]", "secret": "[A-Za-z0-9+/_-]{20}"}  # the same as a pattern; all other kinds need a digit
NEAR = 24  # code points of context


def matches(text: Column, kind: str) -> Column:
    """All matches of a kind's pattern: array of (start, end, value), start and end in code points."""
    pattern = F.lit(PATTERNS[kind])
    between, values = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    both = F.arrays_zip(F.slice(between, F.lit(1), F.size(values)).alias("gap"), values.alias("value"))
    step = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda i: F.slice(both, i * STEP + 1, F.lit(STEP)))
    folded = F.transform(step, lambda part: F.aggregate(
        part,
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"),
            F.concat(acc["found"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"), x["value"].alias("value")))).alias("found"),
        ),
    ))
    starts = F.aggregate(folded, F.array(F.lit(0)), lambda acc, part: F.array_append(acc, F.element_at(acc, -1) + part["at"]))
    moved = F.zip_with(folded, F.slice(starts, F.lit(1), F.size(starts) - 1), lambda part, at: F.transform(part["found"], lambda m: F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["value"].alias("value"))))
    may = F.contains(text, F.lit(NEED[kind])) if kind in NEED else text.rlike(RUN.get(kind, "[0-9]"))
    return F.when(may & (F.size(values) > 0), F.flatten(moved)).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        short = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")) <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def candidate_features(kind: str, text: Column, found: Column) -> list[Column]:
    """Booleans; their order is the model's."""
    value = found["value"]
    n = F.length(value)
    before = F.lower(F.substring(text, F.greatest(found["start"] - NEAR + 1, F.lit(1)), F.least(found["start"], F.lit(NEAR))))
    digits, letters = F.length(_digits(value)), F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    return [
        *(F.lit(kind == k) for k in ADDED),
        n >= 16,
        n >= 32,
        digits * 10 >= n,
        digits * 2 >= n,
        letters * 10 >= n,
        value.rlike("^[0-9a-fA-F]+$"),
        value.rlike("[a-z]") & value.rlike("[A-Z]"),
        value.rlike("[ ().]"),
        value.rlike("[_/-]"),
        F.size(F.array_distinct(F.split(value, ""))) >= 8,
        before.rlike(f"(?:{CONTEXT[kind]})[^a-z]{{0,6}}$") | before.rlike(rf"\b(?:{CONTEXT[kind]})"),
        before.rlike("[=:] ?[\"']?$"),
        before.rlike("[\"']$"),
    ]


FEATURES = len(ADDED) + 13


def examples(spark: SparkSession, rows: int = SAMPLE) -> DataFrame:
    """kind, text, label, held: written examples of public formats and of what looks like them, from the row number; whole
    formats are held out."""
    d = lambda i, n: f"substr(conv(substr(md5(concat('{i}-', id)), 1, 14), 16, 10), 3, {n})"
    w = lambda i, n=9: f"translate(substr(md5(concat('w{i}-', id)), 1, {n}), '0123456789', 'ghijklmnop')"
    hexa, b64 = "sha1(cast(id as string))", "translate(base64(encode(sha1(cast(id as string)), 'utf-8')), '=', 'x')"
    mixed = "translate(substr(base64(unhex(sha2(cast(id as string), 256))), 1, 40), '+/=', 'aBc')"
    forms = [
        ("secret", 1, 0, f"concat('the token = \"', {hexa}, '\" here')"),
        ("secret", 1, 0, f"concat('api_key: ', {b64})"),
        ("secret", 1, 0, "concat('password=', md5(cast(id as string)))"),
        ("secret", 1, 0, f"concat('client_secret = ', {mixed}, ' ;')"),
        ("secret", 1, 1, f"concat('{{\"secret\": \"', {mixed}, '\"}}')"),
        ("secret", 1, 1, f"concat('Authorization: Bearer ', {b64})"),
        ("secret", 0, 0, f"concat('see ', {w(1)}, '-', {w(2)}, '-', {w(3)}, ' there')"),
        ("secret", 0, 0, f"concat('a ', {w(1)}, {w(2)}, {w(3)}, ' word')"),
        ("secret", 0, 0, f"concat('in commit ', {hexa}, ' we')"),
        ("secret", 0, 0, f"concat('key = ', {w(1)}, '_', {w(2)}, '_', {w(3)})"),
        ("secret", 0, 1, f"concat('open ', {w(1)}, '/', {w(2)}, '/', {w(3)}, ' now')"),
        ("secret", 0, 1, f"concat('the digest ', {hexa}, ' of the file')"),
        ("phone_local", 1, 0, f"concat('please call ', {d(1, 3)}, '-', {d(2, 3)}, '-', {d(3, 4)})"),
        ("phone_local", 1, 0, f"concat('tel. (', {d(1, 3)}, ') ', {d(2, 3)}, '-', {d(3, 4)})"),
        ("phone_local", 1, 0, f"concat('my mobile is ', {d(1, 3)}, '.', {d(2, 3)}, '.', {d(3, 4)})"),
        ("phone_local", 1, 1, f"concat('fax ', {d(1, 3)}, ' ', {d(2, 3)}, ' ', {d(3, 4)}, ' ok')"),
        ("phone_local", 0, 0, f"concat('between ', {d(1, 3)}, ' ', {d(2, 3)}, ' ', {d(3, 3)}, ' units')"),
        ("phone_local", 0, 0, f"concat('order ', {d(1, 4)}, '-', {d(2, 4)}, '-', {d(3, 4)})"),
        ("phone_local", 0, 1, f"concat('rows ', {d(1, 3)}, ' ', {d(2, 3)}, ' ', {d(3, 4)}, ' of it')"),
        ("national_id", 1, 0, f"concat('ssn ', {d(1, 3)}, '-', {d(2, 2)}, '-', {d(3, 4)})"),
        ("national_id", 1, 0, f"concat('passport or social ', {d(1, 3)}, '-', {d(2, 2)}, '-', {d(3, 4)})"),
        ("national_id", 1, 1, f"concat('social security: ', {d(1, 3)}, '-', {d(2, 2)}, '-', {d(3, 4)}, '.')"),
        ("national_id", 0, 0, f"concat('part ', {d(1, 3)}, '-', {d(2, 2)}, '-', {d(3, 4)})"),
        ("national_id", 0, 0, f"concat('batch = ', {d(1, 3)}, '-', {d(2, 2)}, '-', {d(3, 4)})"),
        ("national_id", 0, 1, f"concat('screw no. ', {d(1, 3)}, '-', {d(2, 2)}, '-', {d(3, 4)}, ' fits')"),
        ("account", 1, 0, f"concat('iban DE', {d(1, 2)}, ' ', {d(2, 4)}, ' ', {d(3, 4)}, ' ', {d(4, 4)}, ' ', {d(5, 4)}, ' 12')"),
        ("account", 1, 0, f"concat('pay GB', {d(1, 2)}, 'BANK', {d(2, 4)}, {d(3, 4)}, {d(4, 4)})"),
        ("account", 1, 0, f"concat('compte FR', {d(1, 2)}, ' ', {d(2, 4)}, ' ', {d(3, 4)}, ' ', {d(4, 4)}, ' ', {d(5, 4)}, ' ', {d(6, 4)}, ' 123')"),
        ("account", 1, 1, f"concat('account: NL', {d(1, 2)}, 'INGB', {d(2, 4)}, {d(3, 4)}, '12')"),
        ("account", 0, 0, f"concat('model AB', {d(1, 2)}, 'ABCDEFGHIJKL', ' new')"),
        ("account", 0, 0, f"concat('series XR', {d(1, 2)}, ' ', upper({w(1, 4)}), ' ', upper({w(2, 4)}), ' ', upper({w(3, 4)}))"),
        ("account", 0, 1, f"concat('product ZK', {d(1, 2)}, upper({w(1, 4)}), upper({w(2, 4)}), upper({w(3, 4)}), ' sold')"),
        ("email_written", 1, 0, f"concat('mail ', {w(1)}, ' (at) ', {w(2)}, ' (dot) org')"),
        ("email_written", 1, 0, f"concat({w(1)}, '[at]', {w(2)}, '.com')"),
        ("email_written", 1, 0, f"concat('contact ', {w(1)}, '.', {w(2)}, ' [at] ', {w(3)}, ' [dot] net')"),
        ("email_written", 1, 1, f"concat('write to ', {w(1)}, '(at)', {w(2)}, '.org today')"),
        ("email_written", 0, 0, f"concat('we met (at) ', {w(1)}, '. ', {w(2)})"),
        ("email_written", 0, 1, f"concat('arriving (at) ', {w(1)}, '. ', {w(2)}, ' left')"),
    ]
    pick = " ".join(f"when {k} then struct('{kind}' as kind, {label} as label, {held} as held, {text} as text)" for k, (kind, label, held, text) in enumerate(forms))
    return spark.range(0, rows, 1, 1).selectExpr("id", f"case id % {len(forms)} {pick} end as e").select("id", "e.*")


def boost(rows: list[tuple[tuple[bool, ...], int, float]], trees: int = 24, rate: float = 0.4) -> list[tuple[int, int, tuple[float, float, float, float]]]:
    """Depth-two trees (first feature, second feature, leaf per outcome) by second-order boosting of the logistic loss.

    rows: (features, label, count), one for each combination.
    """
    model, scores = [], [0.0] * len(rows)
    for _ in range(trees):
        grads = []
        for (x, y, n), s in zip(rows, scores):
            p = 1 / (1 + math.exp(-s))
            grads.append((n * (y - p), n * p * (1 - p)))
        best = None
        for a in range(FEATURES):
            for b in range(a, FEATURES):
                g, h = [0.0] * 4, [1.0] * 4
                for (x, _, _), (gi, hi) in zip(rows, grads):
                    leaf = 2 * x[a] + x[b]
                    g[leaf] += gi
                    h[leaf] += hi
                gain = sum(gi * gi / hi for gi, hi in zip(g, h))
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, a, b, tuple(round(rate * gi / hi, 6) for gi, hi in zip(g, h)))
        _, a, b, leaves = best
        model.append((a, b, leaves))
        scores = [s + leaves[2 * x[a] + x[b]] for (x, _, _), s in zip(rows, scores)]
    return model


def raw_score(model, x) -> float:
    return sum(leaves[2 * x[a] + x[b]] for a, b, leaves in model)


def platt(scored: list[tuple[float, int, float]], rounds: int = 100) -> tuple[float, float]:
    """a, b such that 1 / (1 + exp(-(a s + b))) is the probability of label 1 at score s.  scored: (score, label, count).

    Newton steps on the logistic loss against smoothed targets, with the slope held positive."""
    good, bad = (sum(n for _, y, n in scored if y == label) for label in (1, 0))
    target = {1: (good + 1) / (good + 2), 0: 1 / (bad + 2)}
    a, b = 1.0, 0.0
    for _ in range(rounds):
        ga = gb = 0.0
        haa, hab, hbb = 1e-6, 0.0, 1e-6
        for s, y, n in scored:
            p = 1 / (1 + math.exp(-max(min(a * s + b, 35.0), -35.0)))
            g, h = n * (p - target[y]), n * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + g * s, gb + g, haa + h * s * s, hab + h * s, hbb + h
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(abs(da), abs(db), 1.0)
        a, b = max(a - da / size, 1e-3), b - db / size
        if max(abs(da), abs(db)) < 1e-7:
            break
    return a, b


def _table(spark: SparkSession, rows: int) -> list:
    found = []
    for kind in ADDED:
        ex = examples(spark, rows).where(F.col("kind") == kind).select("label", "held", "text", F.explode(matches(F.col("text"), kind)).alias("found"))
        found.append(ex.select("label", "held", F.lit(kind).alias("kind"), F.array(*candidate_features(kind, F.col("text"), F.col("found"))).alias("x")))
    table = reduce(DataFrame.union, found).groupBy("held", "kind", "label", "x").agg(F.count(F.lit(1)).alias("n")).collect()  # SAMPLE rows at most
    return sorted(table, key=lambda r: (r["held"], r["kind"], r["label"], r["x"]))


def fit(spark: SparkSession, rows: int = SAMPLE, select: float = SELECT) -> tuple[list, dict[str, float]]:
    """The trees, and for each kind the score at which the probability, calibrated on the held-out formats, is `select`."""
    table = _table(spark, rows)
    model = boost([(tuple(map(int, r["x"])), int(r["label"]), float(r["n"])) for r in table if not r["held"]])
    thresholds = {}
    for kind in ADDED:
        scored = [(raw_score(model, tuple(map(int, r["x"]))), int(r["label"]), float(r["n"])) for r in table if r["held"] and r["kind"] == kind]
        a, b = platt(scored)
        thresholds[kind] = (math.log(select / (1 - select)) - b) / a
    return model, thresholds


def held_out(spark: SparkSession, model=None, rows: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """(precision, recall) of each added kind over the held-out formats."""
    trees, thresholds = model or fit(spark, rows)
    out = {}
    for kind in ADDED:
        table = [(raw_score(trees, tuple(map(int, r["x"]))) >= thresholds[kind] - 1e-9, r["label"], r["n"]) for r in _table(spark, rows) if r["held"] and r["kind"] == kind]
        hit, said, true = (sum(n for s, y, n in table if cond(s, y)) for cond in (lambda s, y: s and y, lambda s, y: s, lambda s, y: y))
        out[kind] = (hit / said if said else 1.0, hit / true if true else 1.0)
    return out


def find(df: DataFrame, text: str = "text", model=None, out: str = "spans") -> DataFrame:
    """df with `out`: array of (kind, start, end), base kinds first as listed, then the added ones, each by start."""
    trees, thresholds = model or fit(df.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    found = df.select(*[c for c in df.columns if c != out])
    for kind in PATTERNS:
        found = found.withColumn(f"__{kind}", matches(t, kind))

    def selected(kind):
        def keep(found):
            if kind in BASE:
                return valid(kind, found["value"])
            x = candidate_features(kind, t, found)
            score = reduce(lambda a, b: a + b, (F.when(x[a] & x[b], leaf[3]).when(x[a], leaf[2]).when(x[b], leaf[1]).otherwise(leaf[0]) for a, b, leaf in trees))
            return score >= thresholds[kind] - 1e-9

        return F.transform(F.filter(f"__{kind}", keep), lambda f: F.struct(F.lit(kind).alias("kind"), f["start"].alias("start"), f["end"].alias("end")))

    lists = [selected(kind) for kind in PATTERNS]
    return found.withColumn(out, F.concat(*lists)).drop(*(f"__{k}" for k in PATTERNS))


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """The text with every span (overlapping ones as one) replaced by its first kind in brackets; spans is dropped."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    folded = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, folded).otherwise(F.col(text))).drop(spans)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans of every whole document."""
    from .common import read

    found = find(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
