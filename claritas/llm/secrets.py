"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds are reported wherever they match. Two wider kinds (tokens shaped like keys, private-key
headers) are only candidates: the hash of each candidate is aggregated over the whole corpus by distinct
owners (sources) and repositories (documents). A value looks live, and is reported, if at most `max_owners`
owners hold it and these hold it in at most `max_copies` documents each on average; a value that more hold
is a widely copied example and is not. The same counts judge the base spans (`n_live`, `n_copied`).

A token is shaped like a key if it starts with the prefix of a known kind of key, or mixes digits, capital
and small letters and has no part between separators that reads like a word (so slugs and paths stay).

A match and its place come from two passes of one pattern: `regexp_extract_all` gives the matches,
`split` the texts between them, and running sums of their lengths the code points before each match.
Running sums go by chunks of about the root of the number of matches, so a text with n matches costs
about n * sqrt(n) small steps and no more memory than its matches.

Nulls: a null text is empty; a null source is one owner. Repeated rows are repositories of their own.
Extra columns are kept by `redact` and ignored by `report`; those whose names begin with `_` may clash
with nothing, as rows are packed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claritas.session import written

# Fixed patterns and least lengths of the base kinds.
KEY = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Candidates of the method.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
KNOWN = r"^(sk_live_|rk_live_|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|AIza|npm_|hf_)"
WORDY = r"(^|[/_=-])[A-Z]?[a-z]{2,}([/_=-]|$)"
KINDS = ["assign", "access", "hex", "token", "pem"]
MARK = "[SECRET]"
MAX_OWNERS = 2
MAX_COPIES = 20
SPANS = "array<struct<start: bigint, kind: int, end: bigint, hash: string>>"
RUNS = "array<struct<start: bigint, end: bigint>>"


def _let(value: Column, body) -> Column:
    """body(value), with `value` computed once however often the body reads it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(values: Column, body) -> Column:
    """body(values, chunks): `values` also in slices of about the root of their number."""

    def cut(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), F.lit(1))
        numbers = lambda w: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int"))
        return _let(width, lambda w: _let(F.transform(numbers(w), lambda c: F.slice(v, c * w + 1, w)), lambda chunks: body(v, w, chunks)))

    return _let(values, cut)


def _running(values: Column, combine) -> Column:
    """For each of `values` (bigint, at least one) the combination of those before it; 0 for the first."""
    zero = F.lit(0).cast("bigint")

    def totals(v: Column, w: Column, chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, zero, combine))
        before = lambda all_: F.transform(all_, lambda _, c: F.aggregate(F.slice(all_, F.lit(1), c), zero, combine))
        each = lambda offsets: F.transform(v, lambda _, i: F.aggregate(F.slice(F.get(chunks, F.floor(i / w).cast("int")), F.lit(1), i % w), F.get(offsets, F.floor(i / w).cast("int")), combine))
        return _let(sums, lambda all_: _let(before(all_), each))

    return _chunks(values, totals)


def _found(text: Column, pattern: str, kind: int, value=None, keep=None) -> Column:
    """array<struct<start, kind, end, hash>> of the matches that `keep` accepts, in order."""
    value = value or (lambda m: m)
    keep = keep or (lambda m: F.lit(True))

    def spans(every: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(every))
        steps = F.zip_with(every, gaps, lambda m, g: F.struct(m.alias("m"), F.char_length(g).cast("bigint").alias("g"), F.char_length(m).cast("bigint").alias("n")))

        def placed(rows: Column) -> Column:
            before = _running(F.transform(rows, lambda r: r["g"] + r["n"]), lambda a, b: a + b)
            found = F.zip_with(
                rows,
                before,
                lambda r, at: F.struct(
                    (at + r["g"]).alias("start"), F.lit(kind).alias("kind"), (at + r["g"] + r["n"]).alias("end"), F.when(keep(r["m"]), F.sha2(value(r["m"]).cast("binary"), 256)).alias("hash")
                ),
            )
            return F.filter(found, lambda s: s["hash"].isNotNull())

        return F.when(F.size(every) > 0, _let(steps, placed)).otherwise(F.array().cast(SPANS))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _apart(wide: Column, base: Column) -> Column:
    """The spans of `wide` that overlap no span of `base`."""

    def sieve(_, __, chunks: Column) -> Column:
        framed = F.transform(chunks, lambda c: F.struct(F.array_min(F.transform(c, lambda b: b["start"])).alias("low"), F.array_max(F.transform(c, lambda b: b["end"])).alias("high"), c.alias("part")))
        meets = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
        inside = lambda s: lambda c: (c["low"] < s["end"]) & (s["start"] < c["high"]) & F.exists(c["part"], lambda b: meets(s, b))
        return _let(framed, lambda all_: F.filter(wide, lambda s: ~F.exists(all_, inside(s))))

    return F.when((F.size(base) == 0) | (F.size(wide) == 0), wide).otherwise(_chunks(base, sieve))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `_base` and `_wide`: spans (code points, end exclusive) of base kinds and of candidates."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    group = lambda m: F.regexp_extract(m, KEY, 2)
    base = F.array_sort(
        F.concat(
            _found(body, KEY, 0, group, lambda m: F.char_length(group(m)) >= 8),
            _found(body, ACCESS, 1),
            _found(body, HEX, 2),
        )
    )
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]") & ~m.rlike(WORDY)
    shaped = lambda m: m.rlike("[0-9]") & ~m.rlike("^[0-9a-f]{32,}$") & (m.rlike(KNOWN) | mixed(m))
    wide = F.concat(_found(body, TOKEN, 3, keep=shaped), _found(body, PEM, 4))
    return docs.select("*", _let(base, lambda b: _let(wide, lambda w: F.struct(b.alias("base"), F.array_sort(_apart(w, b)).alias("wide")))).alias("_both")).select(
        *docs.columns, F.col("_both.base").alias("_base"), F.col("_both.wide").alias("_wide")
    )


def ownership(spans: DataFrame, owner: str = "source", repository: str = "_row") -> DataFrame:
    """(hash, n_owners, n_repositories) over the whole corpus; a hot value is summed before the shuffle."""
    rows = spans.select(F.col(owner).alias("_owner"), F.col(repository).alias("_repo"), F.explode(F.array_distinct(F.transform(F.concat("_base", "_wide"), lambda s: s["hash"]))).alias("hash"))
    each = rows.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def is_live(max_owners: int, max_copies: int) -> Column:
    return (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_copies * F.col("n_owners"))


def judged(rows: DataFrame, max_owners: int = MAX_OWNERS, max_copies: int = MAX_COPIES, counts: DataFrame | None = None) -> DataFrame:
    """(_row, _added, n_live, n_copied) for the rows of `scan` that hold any span; `_row` tells rows apart."""
    held = rows.where(F.size("_base") + F.size("_wide") > 0)
    counts = ownership(held) if counts is None else counts
    flat = held.select("_row", F.explode(F.concat("_base", "_wide")).alias("s")).select("_row", "s", F.col("s.hash").alias("hash"))
    live = is_live(max_owners, max_copies)
    return (
        flat.join(counts, "hash")
        .groupBy("_row")
        .agg(
            F.array_sort(F.collect_list(F.when(live & (F.col("s.kind") >= 3), F.col("s")))).alias("_added"),
            F.sum(live.cast("bigint")).alias("n_live"),
            F.sum((~live).cast("bigint")).alias("n_copied"),
        )
    )


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, max_owners: int = MAX_OWNERS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Digest columns per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    slim = docs.select("doc_id", "source", "text")
    rows = written(scan(slim).drop("text").withColumn("_row", F.monotonically_increasing_id()), "secret-spans")
    out = rows.join(judged(rows, max_owners, max_copies).withColumnRenamed("_row", "_of"), F.col("_row") == F.col("_of"), "left")
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("bigint")
    none = F.array().cast(SPANS)
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("_base", F.coalesce("_added", none)))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"),
    )


def _merged(spans: Column) -> Column:
    """Runs of overlapping or touching spans; `spans` is sorted and not empty."""

    def runs(s: Column) -> Column:
        reach = _running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))  # how far the spans before one go
        heads = lambda before: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] > F.get(before, i)))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        close = lambda before, at: F.transform(at, lambda i, k: F.struct(F.get(s, i)["start"].alias("start"), F.coalesce(F.get(before, F.get(at, k + 1)), last).alias("end")))
        return _let(reach, lambda before: _let(heads(before), lambda at: close(before, at)))

    return _let(spans, runs)


def _cut(text: Column, spans: Column) -> Column:
    """`text` with every run of spans replaced by MARK. Chunks of runs are cut first, then each run in its chunk."""

    def parts(_, __, chunks: Column) -> Column:
        # a chunk's piece of text goes from the end of the chunk before to its own last run
        framed = F.transform(chunks, lambda c, k: F.struct(F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.element_at(F.get(chunks, k - 1), -1)["end"]).alias("at"), c.alias("runs")))

        def piece(c: Column) -> Column:
            whole = F.substring(text, (c["at"] + 1).cast("int"), (F.element_at(c["runs"], -1)["end"] - c["at"]).cast("int"))
            begin = lambda k: F.when(k == 0, c["at"]).otherwise(F.get(c["runs"], k - 1)["end"])
            said = lambda own: F.transform(c["runs"], lambda r, k: F.substring(own, (begin(k) - c["at"] + 1).cast("int"), (r["start"] - begin(k)).cast("int")))
            return _let(whole, lambda own: F.concat(F.array_join(said(own), MARK), F.lit(MARK)))

        end = F.element_at(F.element_at(chunks, -1), -1)["end"]
        tail = F.substring(text, (end + 1).cast("int"), F.char_length(text))
        return _let(framed, lambda all_: F.concat(F.array_join(F.transform(all_, piece), ""), tail))

    return F.when(F.size(spans) == 0, text).otherwise(_chunks(_merged(spans), parts))


def redact(docs: DataFrame, max_owners: int = MAX_OWNERS, max_copies: int = MAX_COPIES) -> DataFrame:
    """`docs` with base spans and live-looking candidates replaced by MARK, and n_chars counted anew.

    Only rows that hold a candidate meet the ownership counts; the others never leave their partition.
    """
    packed = docs.select(F.struct("*").alias("doc"), F.col("source").alias("source"), F.col("text").cast("string").alias("text"))
    rows = written(scan(packed).drop("text").withColumn("_row", F.monotonically_increasing_id()), "secret-rows")
    plain = rows.where(F.size("_wide") == 0).select("doc", F.col("_base").alias("_all"))
    some = rows.where(F.size("_wide") > 0)
    added = judged(rows, max_owners, max_copies).where(F.size("_added") > 0).select(F.col("_row").alias("_of"), "_added")
    some = some.join(added, F.col("_row") == F.col("_of"), "left")
    none = F.filter("_base", lambda s: F.lit(False))
    some = some.select("doc", F.array_sort(F.concat("_base", F.coalesce("_added", none))).alias("_all"))
    both = plain.unionByName(some)
    held = F.size("_all") > 0
    text = F.when(held, _cut(F.col("doc.text").cast("string"), F.col("_all"))).otherwise(F.col("doc.text"))
    both = both.withColumn("text", text)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(held, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return both.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
