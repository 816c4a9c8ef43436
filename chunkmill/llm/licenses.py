"""License scans by canonical digest lookup; native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole
from .license_texts import LICENSES

#: Spellings that count as equal (public matching guidelines of software licence lists), with their plurals and the like.
SPELLINGS = {
    "acknowledgment": "acknowledgement",
    "acknowledgments": "acknowledgements",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "artefacts": "artifacts",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "catalogues": "catalogs",
    "categorise": "categorize",
    "centre": "center",
    "centres": "centers",
    "copyright holder": "copyright owner",
    "copyright holders": "copyright owners",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "favours": "favors",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgment": "judgement",
    "judgments": "judgements",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licencee": "licensee",
    "licencees": "licensees",
    "licences": "licenses",
    "licencing": "licensing",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "non commercial": "noncommercial",
    "offence": "offense",
    "offences": "offenses",
    "optimise": "optimize",
    "organisation": "organization",
    "organisations": "organizations",
    "organise": "organize",
    "organised": "organized",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "programmes": "programs",
    "realise": "realize",
    "recognise": "recognize",
    "recognised": "recognized",
    "signalling": "signaling",
    "sub licence": "sublicense",
    "sub license": "sublicense",
    "sub licenses": "sublicenses",
    "sublicence": "sublicense",
    "sublicences": "sublicenses",
    "utilisation": "utilization",
    "utilise": "utilize",
    "utilised": "utilized",
    "whilst": "while",
    "wilful": "wilfull",
}

#: Lines that name who holds the copyright, which differ from work to work.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n©]*((portions )?copyright[ \t]*(\(c\)|©|<year>|\[year\]|\[yyyy\]|[0-9]{4}|by )|\(c\)[ \t]*[0-9]{4}|©|all rights reserved\W*$)[^\n]*$"


def _bounded(words: str) -> str:
    """Words between the blanks that each has on both sides."""
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    """A text in canonical form: lower case, without copyright lines, letters and digits only with single blanks between, and one spelling."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for a, b in SPELLINGS.items():
        t = F.replace(t, F.lit(_bounded(a)), F.lit(_bounded(b)))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, in hex."""
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license_id and digest of known texts."""
    rows = sorted((texts or LICENSES).items())
    return spark.createDataFrame(rows, "license_id string, text string").select("license_id", digest(F.col("text")).alias("digest"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Each document with the digest of its whole canonical text and the known licence that has it, null if none.

    Rows: doc_id, digest, license_id. The known digests are joined by hash; where several licences have one canonical
    form, the first by name counts. A null or empty text, or one of copyright lines alone, has the empty text's digest
    and no licence. Repeated rows come out each, an empty table gives no rows, other columns are not read.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    known = known.groupBy(F.col("digest").alias("k")).agg(F.min("license_id").alias("license_id")).where(F.col("k") != F.sha2(F.lit("").cast("binary"), 256))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(whole()).alias("digest"))
    return own.join(known, own["digest"] == known["k"], "left").select("doc_id", "digest", "license_id")


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """License scan of all documents."""
    return scan(documents(spark, sf_dir))


def _sql(text: str) -> str:
    pattern = COPYRIGHT_LINE.replace("'", "''")
    t = f"regexp_replace(lower({text}), '{pattern}', '', 'g')"
    t = f"' ' || trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
    for a, b in SPELLINGS.items():
        t = f"replace({t}, '{_bounded(a)}', '{_bounded(b)}')"
    return f"sha256(trim(replace({t}, '  ', ' ')))"


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(LICENSES.items()))
    return f"""
        WITH known AS (SELECT {_sql("t")} AS digest, min(id) AS license_id FROM (VALUES {values}) v(id, t) GROUP BY 1),
        own AS (SELECT doc_id, {_sql("coalesce(text, '')")} AS digest FROM documents)
        SELECT own.doc_id, own.digest, known.license_id FROM own LEFT JOIN known USING (digest)
    """
