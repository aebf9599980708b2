"""Text functions of the evaluation model as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that are verdicts, as themselves and inside JSON.
WORD_VERDICTS = {"yes": "yes", "no": "no", "uncertain": "uncertain", "sì": "yes", "incerto": "uncertain"}
JSON_VERDICTS = {"yes": "yes", "no": "no", "uncertain": "uncertain", "sì": "yes", "incerto": "uncertain", "si": "yes", "true": "yes", "false": "no"}

_WORDS = "|".join(WORD_VERDICTS)
_FIND = f"(?iU)(?<![\\wÀ-ÿ])({_WORDS})(?![\\wÀ-ÿ])"
_BARE = f"(?iU)^[\\s\"'`*_-]*({_WORDS})[\\s.!?\"'`*_-]*$"


def strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _mapped(x: Column, words: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(y) for pair in words.items() for y in pair])
    return F.try_element_at(table, x)


def _answer(candidate: Column) -> tuple[Column, Column]:
    """The verdict in a candidate JSON object, null without one, and whether ``answer`` is its only key."""
    parsed = F.when(F.try_parse_json(candidate).isNotNull() & candidate.startswith("{"), candidate)
    value = F.lower(strip(F.get_json_object(parsed, "$.answer")))
    keys = F.json_object_keys(parsed)
    return _mapped(value, JSON_VERDICTS), F.coalesce((F.size(keys) == 1) & (F.element_at(keys, 1) == "answer"), F.lit(False))


def parse_verdict(raw: DataFrame, id_col: str = "id", text_col: str = "raw") -> DataFrame:
    """id, answer, format_valid and parser of raw model output.

    An unclosed ``<think>`` is truncated.  After the last ``</think>``, the whole
    text, then its first braces, are tried as a JSON object; without a verdict
    there, the distinct verdict words decide: one is the answer, more are
    ambiguous, none is none.
    """
    text = strip(F.coalesce(F.col(text_col), F.lit("")))
    df = raw.select(F.col(id_col).alias("id"), text.alias("t"))
    df = df.withColumn("truncated", F.col("t").contains("<think>") & ~F.col("t").contains("</think>"))
    df = df.withColumn("visible", strip(F.substring_index("t", "</think>", -1)))
    df = df.withColumn("braces", F.regexp_extract("visible", r"(?s)\{.*?\}", 0))
    whole, only = _answer(F.col("visible"))
    inner, _ = _answer(F.col("braces"))
    df = df.withColumns({"whole": whole, "only": only, "inner": inner})
    found = F.array_distinct(F.transform(F.regexp_extract_all("visible", F.lit(_FIND), F.lit(1)), lambda w: _mapped(F.lower(w), WORD_VERDICTS)))
    df = df.withColumns({"found": found, "bare": F.col("visible").rlike(_BARE), "json": F.coalesce("whole", "inner")})
    answer = F.when(F.col("truncated"), "invalid").when(F.col("json").isNotNull(), F.col("json")).when(F.size("found") == 1, F.get("found", F.lit(0))).otherwise("invalid")
    parser = F.when(F.col("truncated"), "truncated").when(F.col("json").isNotNull(), "json").when(F.size("found") == 1, "word").when(F.size("found") > 1, "ambiguous").otherwise("none")
    valid = F.when(F.col("truncated"), False).when(F.col("json").isNotNull(), F.col("whole").isNotNull() & F.col("only")).when(F.size("found") == 1, F.col("bare")).otherwise(False)
    return df.select("id", answer.alias("answer"), F.coalesce(valid, F.lit(False)).alias("format_valid"), parser.alias("parser"))


# The prompt's text.
PROMPT = (
    "Classify the supplied image for a reproducible evaluation.\nQuestion: ",
    '\nReturn exactly one JSON object: {"answer":"yes"} or {"answer":"no"}. If the image genuinely does not permit a decision, use {"answer":"uncertain"}. Do not add markdown or explanations.',
)


def build_prompt(question: Column) -> Column:
    return F.concat(F.lit(PROMPT[0]), strip(question), F.lit(PROMPT[1]))


def slugify(x: Column, default: str = "evaluation") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 60), F.lit("")), F.lit(default))


def normalize_annotator(x: Column, default: str = "revisore") -> Column:
    return F.coalesce(F.nullif(F.substring(strip(F.regexp_replace(x, r"(?U)\s+", " ")), 1, 60), F.lit("")), F.lit(default))


def markdown_cell(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\|", r"\\\\|"), r"[\r\n]+", " ")


def bar_text(x: Column, width: int = 16) -> Column:
    """A bar of block characters; the filled part is rounded half to even."""
    n = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def eta_text(seconds: Column) -> Column:
    """Time left in words: hours and minutes, minutes, or seconds."""
    s = F.round(seconds).cast("long")
    hours, minutes = (s / 3600).cast("long"), (s % 3600 / 60).cast("long")
    return (
        F.when(seconds.isNull(), "unknown").when(seconds < 1, "almost done")
        .when(hours > 0, F.format_string("~%dh %02dm", hours, minutes)).when(minutes > 0, F.format_string("~%d min", minutes)).otherwise(F.format_string("~%ds", s))
    )


def synthetic_answer(image: Column, prompt: Column, seed: Column) -> Column:
    """The deterministic stand-in for a model: yes or no from hashes of image, prompt and seed (a bigint)."""
    byte = lambda x: F.conv(F.substring(F.sha2(x, 256), 1, 2), 16, 10).cast("int")
    image_key, prompt_key = F.unhex(F.sha2(image, 256)), F.unhex(F.sha2(prompt, 256))
    seed_key = F.unhex(F.lpad(F.hex(seed), 16, "0"))
    base = byte(image) % 2
    flip = (byte(F.concat(image_key, prompt_key)) < 54).cast("int")
    again = (byte(F.concat(image_key, seed_key)) < 12).cast("int")
    return F.when((base + flip + again) % 2 == 1, "yes").otherwise("no")


def difference_hash(luminance: Column, width: int, height: int) -> Column:
    """A 64-bit difference hash of row-major luminances: block means of 8 rows by 9 columns, each compared with its right neighbour."""
    if width < 9 or height < 8:
        return F.lit("")

    def cell(r: int, c: int) -> Column:
        top, bottom, left, right = r * height // 8, (r + 1) * height // 8, c * width // 9, (c + 1) * width // 9
        rows = [F.slice(luminance, y * width + left + 1, right - left) for y in range(top, bottom)]
        return F.aggregate(F.concat(*rows), F.lit(0.0), lambda a, x: a + x) / ((bottom - top) * (right - left))

    nibbles = []
    for r in range(8):
        bits = [F.when(cell(r, c) < cell(r, c + 1), F.lit(1)).otherwise(F.lit(0)) for c in range(8)]
        for half in (bits[:4], bits[4:]):
            nibbles.append(F.lower(F.hex(half[0] * 8 + half[1] * 4 + half[2] * 2 + half[3])))
    return F.concat(*nibbles)


# The axes along which a wording may be stressed.
AXES = ("language", "negation", "ambiguity", "paraphrase", "examples", "order", "format", "length")


def unique_slugs(names: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """id and slug of each name in the order of ids: the slug itself if it is free, else the first free number from 2 on behind it.

    Slugs can only collide within a family, those that are equal without their
    trailing numbers.  Families whose slugs have no trailing numbers are numbered
    by rank; the others one by one, as a sorted stream that keeps counters only.
    """
    from pyspark.sql import Window as W

    base = names.select(F.col(id_col).alias("id"), slugify(F.col(name_col)).alias("base")).withColumn("family", F.regexp_replace("base", "(-[0-9]+)+$", ""))
    mixed = base.filter("base != family").select("family").distinct()
    n = F.row_number().over(W.partitionBy("base").orderBy("id"))
    plain = base.join(mixed, "family", "left_anti").withColumn("n", n)
    plain = plain.select("id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("slug"))

    def one_by_one(batches):
        import pyarrow as pa

        family, taken, following = None, set(), {}
        for batch in batches:
            out = []
            for b, f in zip(batch["base"].to_pylist(), batch["family"].to_pylist(), strict=True):
                if f != family:
                    family, taken, following = f, set(), {}
                slug = b
                if slug in taken:
                    k = following.get(b, 2)
                    while f"{b}-{k}" in taken:
                        k += 1
                    slug, following[b] = f"{b}-{k}", k + 1
                taken.add(slug)
                out.append(slug)
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "slug": pa.array(out, pa.string())})

    kind = dict(base.dtypes)["id"]
    rest = base.join(mixed, "family", "left_semi").repartition("family").sortWithinPartitions("family", "id").select("id", "base", "family").mapInArrow(one_by_one, f"id {kind}, slug string")
    return plain.unionByName(rest)


def stress_variants(raw: DataFrame, axes: tuple[str, ...] = AXES, most: int = 8) -> DataFrame:
    """id, axis, text and position of the usable variants in raw generator output (id, canonical, raw).

    The braces of the output are read as {"variants": [{"axis", "text"}]}; entries
    with another axis, an empty or overlong text, the canonical wording (case
    ignored) or a repetition go; the first ``most`` are kept.
    """
    from pyspark.sql import Window as W

    body = F.regexp_extract(F.substring_index("raw", "</think>", -1), r"(?s)\{.*\}", 0)
    items = F.from_json(body, "variants array<struct<axis:string,text:string>>")["variants"]
    one = raw.select("id", "canonical", F.posexplode(items).alias("at", "v")).select("id", "canonical", "at", F.lower(strip(F.col("v.axis"))).alias("axis"), strip(F.col("v.text")).alias("text"))
    fits = F.col("axis").isin(*axes) & (F.length("text") > 0) & (F.length("text") <= 2000) & (F.lower("text") != F.lower(strip(F.col("canonical"))))
    first = F.row_number().over(W.partitionBy("id", "axis", F.lower("text")).orderBy("at"))
    kept = one.filter(fits).withColumn("copy", first).filter("copy = 1")
    return kept.withColumn("position", F.row_number().over(W.partitionBy("id").orderBy("at"))).filter(F.col("position") <= most).select("id", "axis", "text", "position")


def discovered_models(models: DataFrame, need: str = "vision", most: int = 500) -> DataFrame:
    """Distinct names of models (name, capabilities) with a capability, case-blind order; missing capabilities exclude."""
    some = models.filter(F.array_contains(F.coalesce("capabilities", F.array().cast("array<string>")), need)).select(strip(F.col("name")).alias("name")).filter("name != ''")
    return some.distinct().orderBy(F.lower("name"), "name").limit(most)
