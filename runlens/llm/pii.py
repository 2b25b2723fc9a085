"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Candidates are the spans of broad patterns (anything with an @; number-like
runs) and the base spans.  Five labelers vote yes, no or abstain on each:

* ``regex``: the strict pattern of the kind and its checks (parts, digits, Luhn);
* ``size``: number of digits, or length of the address' parts;
* ``gazetteer``: top-level domains, country calling codes, card issuers' first digits;
* ``shape``: digits grouped as cards, phones and addresses are written;
* ``context``: the words before the span.

Expectation-maximisation estimates the share of personal data and each
labeler's reliability from the counts of the vote patterns (at most 3^5 rows
for each candidate kind, whatever the input).  Its posteriors are the soft labels of the
final span classifier, naive Bayes over hashed features (shape, word before,
length, separators), whose sums are grouped by feature.  Candidates that it finds
sure (``SURE``) and that overlap no base span are added; base spans stay.

Spans are in code points, end exclusive, per kind leftmost and not
overlapping.  Null and empty texts have none.  The patterns use possessive
repeats, which match the same here and never run out of stack on long texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.jobs import prepare
from runlens.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
# fixed values: the strict patterns of the four kinds
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# what a text must hold for a kind's pattern and checks to pass at all
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
BROAD = {"at": r"(?:(?<![^\s<>(),;\[\]])|\G)[^\s<>(),;@\[\]]++@[^\s<>(),;@\[\]]++", "number": r"(?<![0-9A-Za-z])\+?[0-9][\x20().0-9-]{6,}[0-9]"}
BROAD_HINTS = {"at": "@", "number": r"[0-9][\x20().0-9-]{6,}[0-9]"}
TOP_LEVEL = "com org net edu gov int info biz io de fr es it uk eu us ca ch at nl be pt pl br mx ar jp cn in au".split()
CALLING = "1 7 20 27 30 31 32 33 34 39 41 43 44 45 46 47 48 49 52 54 55 61 81 86 91".split()
CUES = "mail email contact write call phone tel telephone mobile fax card visa credit ip address server reach appelez correo telefon anruf".split()
ANTI_CUES = "page section version year no figure table chapter isbn issn id order line".split()
LABELERS = ["regex", "size", "gazetteer", "shape", "context"]
BUCKETS = 1024
SURE = 0.95
ROUNDS = 50


def _q(pattern: str) -> str:
    return "r'" + pattern + "'"


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def valid(kind: str, m: str) -> str:
    """SQL condition: the match ``m`` of a kind's pattern passes its checks."""
    if kind == "ip":
        return f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"
    if kind == "phone":
        return f"length({_digits(m)}) between 10 and 15"
    if kind == "card":
        d = _digits(m)
        luhn = (f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + case when i % 2 = 1 then try_cast(substring({d}, length({d}) + 1 - i, 1) as int) "
                f"else pmod(2 * try_cast(substring({d}, length({d}) + 1 - i, 1) as int) - 1, 9) + 1 - if(substring({d}, length({d}) + 1 - i, 1) = '0', 9, 0) end)")
        return f"length({d}) between 14 and 19 and {luhn} % 10 = 0"
    return "true"


def _found(pattern: str, hint: str, kind: str, keep: str, extra: str = "") -> str:
    """SQL array of struct(kind, start, end, m, before): matches with ``keep``, placed by the lengths of what lies between them."""
    fields = f"'{kind}' as kind, acc.at + length(x.gap) as start, acc.at + length(x.gap) + length(x.m) as end, x.m as m, right(x.gap, 32) as before"
    kind_of = "array<struct<kind:string,start:int,end:int,m:string,before:string>>"
    return (
        f"case when text rlike {_q(hint)} then aggregate("
        f"zip_with(split(text, {_q(pattern)}, -1), regexp_extract_all(text, {_q(pattern)}, 0), (g, m) -> struct(coalesce(g, '') as gap, m as m)), "
        f"struct(0 as at, cast(array() as {kind_of}) as out), "
        f"(acc, x) -> struct(acc.at + length(x.gap) + coalesce(length(x.m), 0) as at, "
        f"if(x.m is not null and ({keep}), array_append(acc.out, struct({fields})), acc.out) as out), acc -> acc.out) "
        f"else cast(array() as {kind_of}) end")


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with base (spans of the four kinds) and cand (broad spans that overlap no base span)."""
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for k in KINDS:
        out = out.withColumn(k + "_", F.expr(_found(PATTERNS[k], HINTS[k], k, valid(k, "x.m"))))
    for k in BROAD:
        out = out.withColumn(k + "_", F.expr(_found(BROAD[k], BROAD_HINTS[k], k, "true")))
    out = out.withColumn("base", F.concat(*[F.col(k + "_") for k in KINDS]))
    out = out.withColumn("cand", F.expr("filter(concat(at_, number_), c -> not exists(base, b -> b.start < c.end and c.start < b.end))"))
    return out.drop(*[k + "_" for k in [*KINDS, *BROAD]])


def _votes(c: str, strict: str) -> dict[str, str]:
    """SQL vote (1 yes, 0 no, 2 abstain) of each labeler on candidate ``c``."""
    d, m = f"length({_digits(c + '.m')})", f"{c}.m"
    word = f"lower(regexp_extract({c}.before, r'([A-Za-z]+)[^A-Za-z]*$', 1))"
    domain = f"lower(substring_index({m}, '.', -1))"
    return {
        "regex": strict,
        "size": f"case when {c}.kind in ('email', 'at') then if(length(substring_index({m}, '@', 1)) between 2 and 40 and {m} like '%@%.%', 1, 0) "
                f"when {d} between 10 and 19 then 1 when {d} < 9 then 0 else 2 end",
        "gazetteer": f"case when {c}.kind in ('email', 'at') then if({domain} in ({_list(TOP_LEVEL)}), 1, 0) "
                     f"when {m} like '+%' then if(exists(array({_list(CALLING)}), p -> startswith(substring({_digits(m)}, 1, 3), p)), 1, 0) "
                     f"when {d} between 13 and 19 then if(substring({_digits(m)}, 1, 1) in ('3', '4', '5', '6'), 1, 0) else 2 end",
        "shape": f"case when {c}.kind in ('email', 'at') then if({m} rlike r'^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[A-Za-z]$', 1, 0) "
                 f"when {m} rlike r'^[+]?[0-9]{{0,3}}[ .-]?[(]?[0-9]{{3}}[)]?[ .-][0-9]{{3}}[ .-][0-9]{{4}}$' then 1 "
                 f"when {m} rlike r'^[0-9]{{4}}([ -]?[0-9]{{4}}){{2}}[ -]?[0-9]{{2,7}}$' then 1 "
                 f"when {m} rlike r'^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then 1 else 0 end",
        "context": f"case when {word} in ({_list(CUES)}) then 1 when {word} in ({_list(ANTI_CUES)}) then 0 else 2 end",
    }


def _features(c: str) -> str:
    """SQL array of feature buckets of candidate ``c``."""
    shape = f"regexp_replace(regexp_replace({c}.m, '[0-9]', '9'), '[A-Za-z]+', 'a')"
    group = f"if({c}.kind in ('email', 'at'), 'at', 'number')"
    parts = {"s": f"left({shape}, 40)", "w": f"lower(regexp_extract({c}.before, r'([A-Za-z]+)[^A-Za-z]*$', 1))",
             "n": f"cast(least(40, length({c}.m)) as string)", "d": f"cast(length({_digits(c + '.m')}) as string)",
             "p": f"regexp_replace({c}.m, '[A-Za-z0-9]', '')"}
    return "array(" + ", ".join(f"cast(pmod(xxhash64('{k}', {group}, {v}), {BUCKETS}) as int)" for k, v in parts.items()) + ")"


def estimate(patterns: list[tuple[str, int]]) -> dict[str, float]:
    """Posterior of each vote pattern: expectation-maximisation over (votes, count) rows of one kind group.

    Votes of one item are held independent given its class; abstaining says
    nothing.  Starts from the majority.
    """
    total = sum(n for _, n in patterns)
    post = {p: (1 + p.count("1")) / (2 + p.count("1") + p.count("0")) for p, _ in patterns}
    for _ in range(ROUNDS):
        share = (1 + sum(n * post[p] for p, n in patterns)) / (2 + total)
        rate = []
        for j in range(len(LABELERS)):
            row = []
            for cls in (1, 0):
                weight = [(p[j], n * (post[p] if cls else 1 - post[p])) for p, n in patterns if p[j] != "2"]
                yes = sum(w for v, w in weight if v == "1")
                row.append((2 * cls + 1 + yes) / (4 + sum(w for _, w in weight)))
            rate.append(row)
        for p, _ in patterns:
            odds = math.log(share / (1 - share))
            for j, v in enumerate(p):
                if v != "2":
                    a, b = rate[j]
                    odds += math.log(a / b) if v == "1" else math.log((1 - a) / (1 - b))
            post[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return post


def _literal(values: list[float]) -> Column:
    return F.lit([float(v) for v in values])


def find_pii(docs: DataFrame) -> DataFrame:
    """(row, base, found) of each row of ``docs``: the row itself as a struct, and arrays of
    struct(kind, start, end) ordered by start, then kind as listed.

    ``found`` holds the base spans and those the classifier adds.  Repeated
    rows are looked at each on its own; an empty table gives no row.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = docs.columns
    # the row goes along whole, so its columns may have any name
    seen = candidates(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text"))
    spans = cut_lineage(seen.where("size(base) + size(cand) > 0").select("base", "cand"))
    items = spans.select(F.explode(F.concat(
        F.expr("transform(base, c -> struct(c as c, 1 as strict))"), F.expr("transform(cand, c -> struct(c as c, 0 as strict))"))).alias("i")).select("i.c", "i.strict")
    vote = _votes("c", "if(strict = 1, 1, 0)")
    items = items.select(F.expr("if(c.kind in ('email', 'at'), 'at', 'number')").alias("kind"),
                         F.concat(*[F.expr(vote[k]).cast("string") for k in LABELERS]).alias("votes"), F.expr(_features("c")).alias("features"))
    rows = items.groupBy("kind", "votes").count().collect()  # at most 2 * 3^5 rows
    post = {k: estimate([(r.votes, r["count"]) for r in rows if r.kind == k]) for k in ("at", "number")}
    belief = spark.createDataFrame([(k, v, p) for k in post for v, p in post[k].items()] or [("", "", 0.0)], "kind string, votes string, belief double")
    soft = items.join(F.broadcast(belief), ["kind", "votes"])  # at most 2 * 3^5 rows
    sums = soft.select("belief", F.posexplode("features").alias("place", "feature")).groupBy("place", "feature").agg(
        F.sum("belief").alias("yes"), F.sum(1 - F.col("belief")).alias("no")).collect()  # at most 5 * BUCKETS rows
    yes, no = (sum(r[c] for r in sums if r.place == 0) for c in ("yes", "no"))
    weights = [0.0] * (5 * BUCKETS)
    for r in sums:
        weights[r.place * BUCKETS + r.feature] = math.log((r.yes + 0.5) / (yes + 1)) - math.log((r.no + 0.5) / (no + 1))
    prior, need = math.log((yes + 1) / (no + 1)), math.log(SURE / (1 - SURE))
    order = "array_sort({}, (a, b) -> case when a.start <> b.start then a.start - b.start else cast(array_position(array(" + \
        _list(KINDS) + "), a.kind) - array_position(array(" + _list(KINDS) + "), b.kind) as int) end)"
    kind = ("case when c.kind = 'at' then 'email' when c.m like '+%' then 'phone' when c.m rlike r'^[0-9]{1,3}([.][0-9]{1,3}){3}$' then 'ip' "
            f"when length({_digits('c.m')}) >= 13 then 'card' else 'phone' end")
    out = seen.withColumn("w_", _literal(weights)).withColumn("added", F.expr(
        f"transform(filter(cand, c -> {prior} + aggregate(zip_with({_features('c')}, sequence(0, 4), (f, p) -> element_at(w_, p * {BUCKETS} + f + 1)), 0D, (s, x) -> s + x) "
        f">= {need}), c -> struct({kind} as kind, c.start as start, c.end as end))"))
    out = out.withColumn("base", F.expr("transform(base, c -> struct(c.kind as kind, c.start as start, c.end as end))"))
    out = out.withColumn("found", F.expr(order.format("concat(base, added)"))).withColumn("base", F.expr(order.format("base")))
    return out.select("row", "base", "found")


def _joined(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets (overlapping spans by the first one's)."""
    found = find_pii(docs)
    cut = ("aggregate(found, struct(0 as at, cast(array() as array<string>) as out), (acc, s) -> if(s.start < acc.at, "
           "struct(greatest(acc.at, s.end) as at, acc.out as out), struct(s.end as at, "
           "concat(acc.out, array(substring(row.text, acc.at + 1, s.start - acc.at), concat('<', s.kind, '>'))) as out)), "
           "acc -> concat(array_join(acc.out, ''), substring(row.text, acc.at + 1)))")
    text = F.when(F.size("found") > 0, F.expr(cut)).otherwise(F.col("row.text")).alias("text")
    return found.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op8_weak_supervision(spark, sf_dir: str) -> DataFrame:
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("row.doc_id", *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias("n_" + k) for k in KINDS],
                      F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"))
