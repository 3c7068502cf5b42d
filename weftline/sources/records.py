"""Sparse relations as Parquet, shards with their provenance, and bylines in XML."""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BYLINE = "array<struct<pos:int,last:string,fore:string,orcid:string,affiliations:array<string>>>"


def save_matrix(ties: DataFrame, path: str) -> None:
    """(relation, row, col, value) as Parquet, a folder a relation, rows near each other; an existing one is refused."""
    ties.select("relation", "row", "col", "value").repartition("relation", F.floor(F.col("row") / 1_000_000)).sortWithinPartitions("relation", "row", "col").write.partitionBy("relation").parquet(path)


def load_matrix(spark: SparkSession, path: str, relation: str | None = None) -> DataFrame:
    """The ties, of one relation if it is named (other folders are not read)."""
    out = spark.read.parquet(path).withColumn("relation", F.col("relation").cast("string"))
    return out if relation is None else out.where(F.col("relation") == relation)


def shards(spark: SparkSession, pattern: str, kind: str = "json", **options: str) -> DataFrame:
    """All files of a glob with the name of the file each row comes from."""
    return spark.read.format(kind).options(**options).load(pattern).withColumn("shard", F.regexp_extract("_metadata.file_path", "([^/]+)$", 1))


def _name(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _text(node: ElementTree.Element | None) -> str | None:
    text = " ".join("".join(node.itertext()).split()) if node is not None else ""
    return text or None


def byline(xml: str | None) -> list[dict] | None:
    """Authors of a record in page order, in either of two forms: contributors with cross-referenced affiliations, or an
    author list with affiliations inside.  None for what can't be parsed; an empty list for a record without authors."""
    if not xml:
        return None
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    nodes = list(root.iter())
    places = {n.get("id"): _text(n) for n in nodes if _name(n) == "aff" and n.get("id")}
    out = []
    for n in nodes:
        kids = {_name(k): k for k in n.iter()}
        if _name(n) == "contrib" and n.get("contrib-type", "author") == "author":
            orcid = next((_text(k) for k in n.iter() if _name(k) == "contrib-id" and k.get("contrib-id-type") == "orcid"), None)
            own = [places.get(k.get("rid")) for k in n.iter() if _name(k) == "xref" and k.get("ref-type") == "aff"]
            last, fore = _text(kids.get("surname")), _text(kids.get("given-names"))
        elif _name(n) == "Author":
            orcid = next((_text(k) for k in n.iter() if _name(k) == "Identifier" and k.get("Source") == "ORCID"), None)
            own = [_text(k) for k in n.iter() if _name(k) == "Affiliation"]
            last, fore = _text(kids.get("LastName")), _text(kids.get("ForeName"))
        else:
            continue
        digits = orcid.rstrip("/").rsplit("/", 1)[-1] if orcid else None
        out.append({"pos": len(out) + 1, "last": last, "fore": fore, "orcid": digits, "affiliations": [x for x in own if x]})
    return out


def parsed_byline(xml: Column) -> Column:
    """``byline`` as a column."""

    @F.pandas_udf(BYLINE)
    def work(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda x: byline(x) if isinstance(x, str) else None)

    return work(xml)
