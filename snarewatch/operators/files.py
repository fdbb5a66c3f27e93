"""Attachments: names, sizes, archive listings, raw bytes and the file's risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snarewatch.functions import constants as C
from snarewatch.functions import risk

TOO_LARGE = 20 * 1024 * 1024
#: Inner and outer extensions of an archive that poses as a document.
LURE_INNER = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
LURE_OUTER = ("zip", "rar", "7z", "z")
#: Controls that reverse the reading order of a name.
BIDI = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
#: Documents that are archives by design.
ZIP_DOCUMENTS = ("docx", "docm", "xlsx", "xlsm", "pptx", "pptm", "odt", "ods", "odp", "epub")


def extension(name: Column, back: int = 1) -> Column:
    """The last extension of a name, or with ``back`` = 2 the one inside it; else null."""
    parts = F.split(F.lower(name), r"\.")
    return F.when(F.size(parts) > back, F.element_at(parts, -back))


def filename_risk(files: DataFrame) -> DataFrame:
    """Add inner_ext, outer_ext, name_score and name_warning (null if nothing is odd)."""
    wide = files.withColumn("outer_ext", extension(F.col("file_name"))).withColumn("inner_ext", extension(F.col("file_name"), 2))
    document = F.col("inner_ext").isin(*C.DOCUMENT_EXT)
    program = F.col("outer_ext").isin(*C.EXECUTABLE_EXT)
    disguised, packed = document & program, document & F.col("outer_ext").isin(*C.ARCHIVE_EXT)
    return wide.withColumn("name_score", F.when(disguised, 60).when(packed, 30).when(program, 35).otherwise(0)).withColumn(
        "name_warning", F.when(disguised, "disguised_executable").when(packed, "disguised_archive").when(program, "lone_executable")
    )


def size_bucket(size: Column) -> Column:
    mb = size / (1024 * 1024)
    named = F.when(mb <= 20, "under-20MB").when(mb <= 50, "20-50MB").when(mb <= 200, "50-200MB").when(mb <= 1000, "200MB-1GB")
    return F.when(size.isNull(), "unknown").otherwise(F.coalesce(named, F.lit("over-1GB")))


def unscannable(files: DataFrame) -> DataFrame:
    """Add scan_error and blind_disguise: too large to read, and posing as something else.

    A file that was not read stays a row: no antivirus answer, its name's risk kept.
    """
    large = F.col("size_bytes") > TOO_LARGE
    lure = F.col("inner_ext").isin(*LURE_INNER) & F.col("outer_ext").isin(*LURE_OUTER)
    posing = (F.col("name_warning") == "disguised_executable") | ((F.col("name_warning") == "disguised_archive") & lure)
    return files.withColumn("scan_error", F.when(large, "too_large")).withColumn("blind_disguise", large & F.coalesce(posing, F.lit(False)))


def display_name(name: Column) -> Column:
    clean = F.trim(F.replace(F.regexp_replace(name, r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]", ""), F.lit("`"), F.lit("'")))
    short = F.when(F.length(clean) > 80, F.concat(F.substring(clean, 1, 79), F.lit("…"))).otherwise(clean)
    return F.when(short == "", "?").otherwise(short)


def archive_findings(entries: DataFrame) -> DataFrame:
    """Findings of each archive listing: file_id, finding, score, entry.

    A disguised program (or a name with reading-order controls) hides a plain one;
    ``entry`` is the first such name. Partial sums run before the shuffle.
    """
    base = F.regexp_replace("entry_name", r"^.*[/\\]", "")
    rows = entries.withColumn("base", base).withColumn("outer", extension(F.col("base"))).withColumn("inner", extension(F.col("base"), 2))
    bidi = F.col("base").rlike(BIDI)
    program = F.col("outer").isin(*C.EXECUTABLE_EXT)
    disguised = bidi | (program & F.coalesce(F.col("inner").isin(*C.DOCUMENT_EXT), F.lit(False)))
    found = rows.groupBy("file_id").agg(
        F.min(F.when(disguised, F.struct("entry_no", "base"))).alias("d"),
        F.min(F.when(program & ~disguised, F.struct("entry_no", "base"))).alias("x"),
        F.bool_or("encrypted").alias("locked"),
        F.count("*").alias("n"),
    )
    one = lambda condition, name, score, entry: F.when(
        condition, F.struct(F.lit(name).alias("finding"), F.lit(score).alias("score"), entry.alias("entry"))
    )
    none = F.lit(None).cast("string")
    listed = F.array_compact(
        F.array(
            one(F.col("d").isNotNull(), "disguised_entry", 85, display_name(F.col("d.base"))),
            one(F.col("d").isNull() & F.col("x").isNotNull(), "executable_entry", 70, display_name(F.col("x.base"))),
            one(F.col("locked"), "encrypted", 45, none),
            one(F.col("n") >= 2000, "too_many_entries", 30, none),
        )
    )
    return found.select("file_id", F.explode(listed).alias("f")).select("file_id", "f.finding", "f.score", "f.entry")


def archive_kinds(entries: DataFrame) -> DataFrame:
    """Per archive: is it an app package, an office document, one with macros."""
    low = entries.withColumn("low", F.lower("entry_name"))
    has = lambda name: F.bool_or(F.col("low") == name)
    return low.groupBy("file_id").agg(
        (has("androidmanifest.xml") & has("classes.dex")).alias("is_apk"),
        (has("[content_types].xml") | has("mimetype")).alias("is_office"),
        F.bool_or(F.col("low").endswith("vbaproject.bin")).alias("has_macros"),
    )


def kind_findings(files: DataFrame, entries: DataFrame) -> DataFrame:
    """What an archive's listing says of its file: file_id, finding, score, entry.

    An app package under another name, and macros in an office document.
    """
    kinds = archive_kinds(entries).join(files.select("file_id", extension(F.col("file_name")).alias("claimed")).hint("merge"), "file_id")
    disguised = F.col("is_apk") & ~F.coalesce(F.col("claimed") == "apk", F.lit(False))
    rules = (("disguised_app_package", 85, disguised), ("office_macros", 50, ~F.col("is_apk") & F.col("is_office") & F.col("has_macros")))
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("finding"), F.lit(v).alias("score"))) for n, v, c in rules]))
    return kinds.select("file_id", F.explode(rows).alias("f")).select("file_id", "f.finding", "f.score", F.lit(None).cast("string").alias("entry"))


def all_findings(files: DataFrame, entries: DataFrame) -> DataFrame:
    """The strongest finding of each kind that a file's listing gives.

    App packages and office documents are judged as such, not by single entries.
    """
    known = archive_kinds(entries).where("is_apk or is_office").select("file_id")
    single = archive_findings(entries).join(known.hint("merge"), "file_id", "left_anti")
    return best_findings(single.unionByName(kind_findings(files, entries)))


def best_findings(findings: DataFrame) -> DataFrame:
    """The strongest finding of each kind a file."""
    return findings.groupBy("file_id", "finding").agg(F.max("score").alias("score"), F.max_by("entry", "score").alias("entry"))


def engine_risk(malicious: Column) -> Column:
    return F.when(malicious >= 10, 95).when(malicious >= 5, 85).when(malicious >= 2, 70).when(malicious >= 1, 45).otherwise(0)


def local_scores(named: DataFrame, findings: DataFrame) -> DataFrame:
    """Add local_score: the strongest of the name's and the findings' scores."""
    top = findings.groupBy("file_id").agg(F.max("score").alias("found_score"))
    return named.join(top.hint("merge"), "file_id", "left").withColumn("local_score", F.greatest("name_score", F.coalesce("found_score", F.lit(0))))


def file_risk(scored: DataFrame) -> DataFrame:
    """Add file_pct (null if nothing vouches for the file) and file_level.

    An answer counts only if the service knew this very file; "never seen" and
    "unreachable" are no evidence of safety.
    """
    local = F.col("local_score")
    answered = F.col("found") & F.coalesce(F.col("checked"), F.lit(True))
    pct = (
        F.when(answered & (F.col("malicious") > 0), engine_risk(F.col("malicious")) + F.floor(local / 2))
        .when(answered, local)
        .when(F.col("blind_disguise"), F.greatest(F.lit(risk.HIGH_FROM), local + 30))
        .when(local >= risk.MEDIUM_FROM, local)
    )
    return scored.withColumn("file_pct", risk.clamp(pct).cast("int")).withColumn("file_level", F.coalesce(risk.level(F.col("file_pct")), F.lit("uncertain")))


def files_with_risk(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Names, findings, reputation and risk of every file; none is left out."""
    named = unscannable(filename_risk(files))
    return file_risk(local_scores(named, all_findings(files, entries)))


def top_reasons(files: DataFrame, entries: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` reasons a file, strongest first; the name's warning goes before ties."""
    name = filename_risk(files).where("name_warning is not null").select(
        "file_id", F.col("name_warning").alias("reason"), F.col("name_score").alias("score"), F.lit(0).alias("side")
    )
    found = all_findings(files, entries).select("file_id", F.col("finding").alias("reason"), "score", F.lit(1).alias("side"))
    turn = Window.partitionBy("file_id").orderBy(F.desc("score"), "side", "reason")
    return name.unionByName(found).withColumn("place", F.row_number().over(turn)).where(F.col("place") <= most).drop("side")


def engine_labels(answers: DataFrame, engines: tuple[str, ...]) -> DataFrame:
    """What named engines say in a service's JSON answer (column ``body``): file_id and a column each."""
    given = F.from_json("body", "map<string,struct<category:string,result:string>>")

    def label(name: str) -> Column:
        e = F.try_element_at(F.col("given"), F.lit(name))
        said = F.concat(F.lit(" ("), e["result"], F.lit(")"))
        return F.when(e["category"] == "malicious", F.concat(F.lit("Detected"), said)).when(e["category"] == "suspicious", F.concat(F.lit("Suspicious"), said)).otherwise("Clean")

    return answers.withColumn("given", given).select("file_id", *[label(e).alias(e.lower()) for e in engines])


# --- raw bytes, from spark.read.format("binaryFile") with columns path, length, content


def read_files(spark, path: str) -> DataFrame:
    """Files of a folder: file_name, length, digest, content and scan_error.

    A file over the limit is a row with scan_error ``too_large`` whose bytes are not read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name, nothing = F.substring_index("path", "/", -1).alias("file_name"), F.lit(None)
    read = found.where(F.col("length") <= TOO_LARGE).select(name, "length", F.sha2("content", 256).alias("digest"), "content", nothing.cast("string").alias("scan_error"))
    large = found.where(F.col("length") > TOO_LARGE).select(
        name, "length", nothing.cast("string").alias("digest"), nothing.cast("binary").alias("content"), F.lit("too_large").alias("scan_error")
    )
    return read.unionByName(large)


def _starts(content: Column, *heads: str) -> Column:
    found = F.lit(False)
    for head in heads:
        found = found | (F.hex(F.substring(content, 1, len(head) // 2)) == head)
    return found


def magic_type(content: Column) -> Column:
    """Program or archive by its first bytes; a PE header must be where it is said to be."""
    head = F.hex(F.substring(content, 61, 4))
    swapped = F.concat(*[F.substring(head, i, 2) for i in (7, 5, 3, 1)])
    at = F.conv(swapped, 16, 10).cast("bigint")
    inside = (F.length(head) == 8) & (at < F.length(content))
    windows = _starts(content, "4D5A") & inside & (F.hex(F.substring(content, F.when(inside, at.cast("int") + 1).otherwise(1), F.lit(4))) == "50450000")
    return (
        F.when(windows, "Windows program")
        .when(_starts(content, "7F454C46"), "Linux program")
        .when(_starts(content, "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE"), "macOS program")
        .when(_starts(content, "504B0304", "504B0506"), "ZIP")
        .when(_starts(content, "526172211A0700", "526172211A070100"), "RAR")
        .when(_starts(content, "377ABCAF271C"), "7Z")
    )


def byte_findings(files: DataFrame) -> DataFrame:
    """What the bytes of read files say against their names: file_name, finding, score."""
    kind = magic_type(F.col("content"))
    text = F.decode("content", "ISO-8859-1")
    claimed = extension(F.col("file_name"))
    program = F.col("kind").endswith("program") & ~F.coalesce(claimed.isin(*C.EXECUTABLE_EXT), F.lit(False))
    archive = F.col("kind").isin("ZIP", "RAR", "7Z") & claimed.isin(*C.DOCUMENT_EXT) & ~claimed.isin(*ZIP_DOCUMENTS)
    pdf = F.substring(F.col("text"), 1, 1024).contains("%PDF-")
    macro = "_VBA_PROJECT".encode("utf-16-le").decode("latin-1")
    ole = _starts(F.col("content"), "D0CF11E0A1B11AE1") & F.col("text").contains(macro)
    rules = (
        ("reversed_name", 85, F.col("file_name").rlike(BIDI)), ("disguised_executable", 85, program), ("disguised_archive", 30, archive),
        ("office_macros", 50, ole), ("pdf_launch", 70, pdf & F.col("text").rlike(r"/Launch([^A-Za-z0-9]|$)")),
        ("pdf_javascript", 45, pdf & F.col("text").rlike(r"/(JavaScript|JS)([^A-Za-z0-9]|$)")),
    )
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("finding"), F.lit(s).alias("score"))) for n, s, c in rules]))
    found = files.withColumn("kind", kind).withColumn("text", text).select("file_name", F.explode(rows).alias("f"))
    return found.select("file_name", "f.finding", "f.score")
