"""Personal data by bootstrapped contextual extraction, in built-in expressions only.

Seeds are identifiers that patterns and checks prove (emails, IPv4 addresses,
payment cards, phone numbers).  The labels that precede them ("phone:", "mail=")
and the one to three words on either side ("call me at _", "_ is my number")
become lexical patterns.  A graph of patterns and instances is scored in rounds:
a pattern is as reliable as its instances are on average, an instance as its best
pattern; what is found supports further patterns, and reliable patterns name
identifiers that no check knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, boxed, row_keys, unboxed

SPACE = r"\x20\x09-\x0D"
#: The quantifiers are possessive and starts are anchored, so matching is linear and never recurses; the matches are those of the plain forms.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: Several groups of digits, joined by what may join them in a phone or card number.
RUN = r"(?<![\p{L}0-9])[+(]*+[0-9]++(?:[\x20().-]++[0-9]++)++"
KINDS = ("email", "ip", "card", "phone")
#: Instances that a pattern needs that are seeds or believed in, the most rounds of scoring, and the reliability that a pattern needs.
LEAST_SEEDS = 3
MOST_ROUNDS = 10
SETTLED = 1e-3
RELIABLE = 0.7
LEAST_DIGITS = 6
#: Digits of the longest number that a run may be; words of the longest context.
MOST_DIGITS = 19
CONTEXT_WORDS = 3
_SPAN = "struct<start:int,end:int,m:string,before:string,after:string>"


def _located(t: Column, pattern: str, gate: Column) -> Column:
    """All matches with code-point offsets and up to 64 characters before and after each, up to the next match."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    parts = F.split(t, pattern, -1)
    pieces = F.arrays_zip(F.slice(parts, F.lit(1), F.size(found)).alias("p"), F.slice(parts, F.lit(2), F.size(found)).alias("q"))
    step = F.zip_with(found, pieces, lambda m, x: F.struct(F.length(x["p"]).alias("skip"), F.length(m).alias("size"), m.alias("m"), F.right(x["p"], F.lit(64)).alias("before"), F.left(x["q"], F.lit(64)).alias("after")))

    def add(a, x):
        start = a["at"] + x["skip"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    return F.when(gate, F.aggregate(step, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda a: a["out"])).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    rev = F.reverse(_digits(m))

    def add(a, i):
        d = F.substring(rev, i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    n = F.length(rev)
    return n.between(14, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(19)))), F.lit(0), add) % 10 == 0)


def _byte_parts(m: Column) -> Column:
    def fits(x):
        short = F.ltrim(x, F.lit("0"))
        return F.when(F.length(short) > 3, F.lit(False)).otherwise(F.coalesce(F.nullif(short, F.lit("")).cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, r"\."), fits)


def _label(before: Column) -> Column:
    """The label that ends what precedes an identifier, or an empty string."""
    return F.lower(F.regexp_extract(before, rf"(\p{{L}}[^{SPACE}]*[:=#])[{SPACE}]*$", 1))


def _patterns(label: Column, before: Column, after: Column) -> Column:
    """The lexical patterns of a place: its label, and the last words before and first words after the identifier `_`."""

    def words(text):
        bare = F.transform(F.split(F.lower(text), rf"[{SPACE}]+", -1), lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""))
        return F.filter(bare, lambda w: w != "")

    def ends(a, left):
        def some(n):
            own = F.when(F.size(a) >= n, F.slice(a, -n if left else 1, n))
            text = F.array_join(own, " ")
            return F.concat(text, F.lit(" _")) if left else F.concat(F.lit("_ "), text)

        return [some(n) for n in range(1, CONTEXT_WORDS + 1)]

    # computed once per place: the words are lambda variables
    sides = F.array(F.struct(words(before).alias("b"), words(after).alias("a")))
    every = F.flatten(F.transform(sides, lambda x: F.array(F.when(label != "", label), *ends(x["b"], True), *ends(x["a"], False))))
    return F.filter(every, lambda x: x.isNotNull())


def _seed(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), _patterns(_label(x["before"]), x["before"], x["after"]).alias("patterns"), x["m"].alias("m"))


def _numbered(kind: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: the base spans by kind, and the other candidates with their patterns."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digit = F.regexp_like(F.col("t"), F.lit("[0-9]"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(k.alias(f"key_{k_}") for k, k_ in zip(row_keys(id_col, text_col), "ab", strict=True)), t.alias("t"))
    base = base.select(
        "doc_id", "key_a", "key_b",
        _located(F.col("t"), EMAIL, F.contains("t", F.lit("@"))).alias("email"),
        F.filter(_located(F.col("t"), IP, digit), lambda x: _byte_parts(x["m"])).alias("ip"),
        F.filter(_located(F.col("t"), CARD, digit), lambda x: _luhn(x["m"])).alias("card"),
        F.filter(_located(F.col("t"), PHONE, F.contains("t", F.lit("+"))), lambda x: F.length(_digits(x["m"])).between(10, 15)).alias("phone"),
        _located(F.col("t"), CANDIDATE, digit | F.contains("t", F.lit("@"))).alias("words"),
        _located(F.col("t"), RUN, digit).alias("runs"),
    )
    every = F.concat(*[F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS])

    def candidate(x):
        own = F.regexp_extract(x["m"], r"^(\p{L}[\p{L}_.-]*[:=#])", 1)
        body = F.substr(x["m"], F.length(own) + 1)
        tail = F.length(F.regexp_extract(body, r"([.,;:!?)\"'\]]*)$", 1))
        lead = F.length(F.regexp_extract(body, r"^([(\"'\[]*)", 1))
        start = x["start"] + F.length(own) + lead
        end = F.greatest(start, x["end"] - tail)
        return F.struct(start.alias("start"), end.alias("end"), F.substr(x["m"], F.length(own) + lead + 1, end - start).alias("m"), _patterns(F.when(own != "", F.lower(own)).otherwise(_label(x["before"])), F.concat(x["before"], F.lit(" "), own), x["after"]).alias("patterns"))

    def run(x):
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), _patterns(_label(x["before"]), x["before"], x["after"]).alias("patterns"))

    def apart(spans):
        return lambda x: ~F.exists(spans, lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"]))

    enough = F.filter("words", lambda x: (F.length(_digits(x["m"])) >= LEAST_DIGITS) | (x["m"].contains("@")))
    free = F.filter(F.transform(F.filter(enough, apart("every")), candidate), lambda x: (F.length(_digits(x["m"])) >= LEAST_DIGITS) | (x["m"].contains("@")))
    numbers = F.filter("runs", lambda x: F.length(_digits(x["m"])).between(LEAST_DIGITS, MOST_DIGITS))
    numbers = F.transform(F.filter(numbers, apart("every")), run)
    free = F.concat(F.filter(free, apart("numbers")), F.col("numbers"))
    free = F.filter(free, lambda x: F.size(x["patterns"]) > 0)
    seeds = F.concat(*[F.transform(k, _seed(k)) for k in KINDS])
    out = base.withColumn("every", every).withColumn("numbers", numbers).select("doc_id", "key_a", "key_b", *[F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS], F.filter(seeds, lambda x: F.size(x["patterns"]) > 0).alias("seeds"), free.alias("free"))
    return out.withColumn("row", F.monotonically_increasing_id())


def reliable_patterns(table: DataFrame, work: Workspace) -> DataFrame:
    """(label, kind, reliability) of the patterns that the graph of patterns and instances proves.

    A round scores a pattern by the mean belief in its instances, if at least
    LEAST_SEEDS of them are believed in, and an instance by its best reliable pattern.
    Instances that are found so support patterns that no seed has.  Rounds end when
    no pattern comes or goes and their mean score settles, and after MOST_ROUNDS at
    the latest.
    """
    seeds = table.select(F.explode("seeds").alias("s")).select(F.explode("s.patterns").alias("label"), "s.kind", "s.m").distinct()
    loose = table.select(F.explode("free").alias("f")).select(F.explode("f.patterns").alias("label"), "f.m")
    every = work.keep(seeds.select("label", "m").unionByName(loose).distinct(), "every")
    size = every.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST_SEEDS)
    edges = work.keep(every.join(size, "label"), "edges")  # a label of fewer instances never counts
    work.drop("every")
    sure = work.keep(seeds.select("kind", "m").distinct(), "sure")
    belief, before = sure.select("m", "kind", F.lit(1.0).alias("score")), None
    for i in range(MOST_ROUNDS):
        scored = edges.join(belief, "m").groupBy("label", "kind").agg(F.sum("score").alias("total"), F.count_if(F.col("score") >= RELIABLE).alias("believed"), F.max("size").alias("size"))
        patterns = work.keep(scored.where(F.col("believed") >= LEAST_SEEDS).select("label", "kind", (F.col("total") / F.col("size")).alias("reliability")), f"patterns-{i}")
        now = patterns.agg(F.count("*").alias("n"), F.count_if(F.col("reliability") >= RELIABLE).alias("reliable"), F.coalesce(F.avg("reliability"), F.lit(0.0)).alias("mean")).first()
        if before and (now.n, now.reliable) == (before.n, before.reliable) and abs(now["mean"] - before["mean"]) < SETTLED:
            break
        before = now
        # seeds stay certain; what is found is as certain as its best pattern
        guess = edges.join(patterns, "label").groupBy("m", "kind").agg(F.max("reliability").alias("score"))
        found = guess.join(sure, ["m", "kind"], "left_anti").unionByName(sure.select("m", "kind", F.lit(1.0).alias("score")))
        belief = work.keep(found, f"belief-{i}")
        work.drop(*((f"belief-{i - 1}", f"patterns-{i - 1}") if i else ()))
    best = patterns.groupBy("label").agg(F.max(F.struct("reliability", "kind")).alias("b"))
    return best.select("label", "b.kind", "b.reliability").where(F.col("reliability") >= RELIABLE)


def _listed(spans: Column) -> Column:
    """kind:start:end in order of start, then of kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"], x["end"])), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (start, kind number, end), sorted; `base` are the seeds.

    Offsets count code points, end exclusive.  Null and empty texts have no span.
    Repeated rows are searched one by one; spans of different kinds may overlap;
    of an instance's patterns the most reliable one names its kind, and of equal
    reliabilities the last kind by name.  Other columns are
    ignored.  With `keys`, the two numbers of workspace.row_keys come too.
    """
    work = Workspace(docs.sparkSession, "pii")
    table = work.keep(_spans(docs, id_col, text_col), "spans")
    patterns = work.keep(reliable_patterns(table, work), "reliable")
    number = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS, 1)])
    loose = table.where(F.size("free") > 0).select("row", F.explode("free").alias("f")).select("row", "f.start", "f.end", F.explode("f.patterns").alias("label"))
    best = loose.join(patterns, "label").groupBy("row", "start", "end").agg(F.max(F.struct("reliability", "kind")).alias("b")).select("row", "start", "end", "b.kind")
    found = best.groupBy("row").agg(F.collect_set(F.struct("start", number.alias("kind"), "end")).alias("found"))
    base = F.concat(*[F.transform(k, _numbered(i)) for i, k in enumerate(KINDS, 1)])
    out = table.select("row", "doc_id", "key_a", "key_b", F.array_sort(base).alias("base")).join(found, "row", "left")
    named = [F.col("key_a").alias("row"), F.col("key_b").alias("row2")] if keys else []
    return out.select("doc_id", *named, "base", F.array_sort(F.concat("base", F.coalesce("found", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")))).alias("spans"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with every span replaced by its kind in angle brackets.

    Spans belong to the row's own id and text, so rows that share an id, or have
    none, are masked each by its own spans.  Texts without spans, null ones
    included, come back as they are; repeated rows come back as often as they
    occur; column names may be any.  Of overlapping spans the first one counts.
    """
    work = Workspace(docs.sparkSession, "mask")
    spans = find_personal_data(docs, id_col, text_col, keys=True).where(F.size("spans") > 0)
    spans = work.keep(spans.groupBy("row", "row2").agg(F.first("spans").alias("spans")), "spans")
    t, own = F.col("box").getField(text_col), F.col("box").getField(id_col)
    # both sides are tables: Spark broadcasts the spans if their size allows, and else shuffles
    joined = boxed(docs).select("box", *row_keys(own, t)).join(spans, ["row", "row2"], "left")

    def add(a, x):
        name = F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), x["kind"]), F.lit(">"))
        out = F.concat(a["out"], F.substr(t, a["at"] + 1, x["start"] - a["at"]), name)
        return F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), out.alias("out"))).otherwise(a)

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda a: F.concat(a["out"], F.substr(t, a["at"] + 1, F.length(t))))
    return unboxed(joined, docs.columns, **{text_col: F.when(F.col("spans").isNull() | t.isNull(), t).otherwise(clean)})


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole documents table."""
    out = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS, 1)], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
