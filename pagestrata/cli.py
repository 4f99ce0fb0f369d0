"""Files of pages to results from a command line or spark-submit:

    spark-submit --py-files pagestrata.zip -m pagestrata.cli text s3a://bucket/papers --out s3a://bucket/texts
    python -m pagestrata.cli tables file.pdf --format csv
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import layout, pages, tables
from .plans import verbs
from .sources import sinks
from .sources.pdf import reader

VERBS = ("text", "html", "xml", "hocr", "tag", "words", "tables", "chars", "shapes", "images", "objects", "trailer", "outline", "metadata", "embedded", "structure", "annotations", "labels")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagestrata", description=__doc__.split("\n")[0])
    p.add_argument("verb", choices=VERBS)
    p.add_argument("path", help="a file or a folder, in any store that Spark reads")
    p.add_argument("--out", help="a folder for the results; without it they are printed")
    p.add_argument("--format", choices=("json", "csv", "parquet", "text"), default="json")
    p.add_argument("--pages", help="pages from 1, such as 1,3-5")
    p.add_argument("--maxpages", type=int, default=0)
    p.add_argument("--password", default="")
    p.add_argument("--codec", choices=("raw", "binary", "text"), help="how streams of objects are shown")
    p.add_argument("--precision", type=int)
    p.add_argument("--vertical-strategy", default="lines", choices=tables.STRATEGIES)
    p.add_argument("--horizontal-strategy", default="lines", choices=tables.STRATEGIES)
    for name in ("line-overlap", "char-margin", "line-margin", "word-margin"):
        p.add_argument(f"--{name}", type=float, default=getattr(layout.LayoutSettings(), name.replace("-", "_")))
    p.add_argument("--boxes-flow", default="0.5", help="a number from -1 to 1, or disabled")
    p.add_argument("--detect-vertical", action="store_true")
    p.add_argument("--reconstruct", action="store_true", help="right-to-left text in logical order")
    return p


def _settings(a: argparse.Namespace) -> layout.LayoutSettings:
    flow = None if a.boxes_flow == "disabled" else float(a.boxes_flow)
    return layout.LayoutSettings(a.line_overlap, a.char_margin, a.line_margin, a.word_margin, flow, a.detect_vertical)


def _numbers(a: argparse.Namespace) -> list[int] | None:
    wanted = pages.parse_page_spec(a.pages) if a.pages else None
    if wanted and min(wanted) < 1:
        raise ValueError("page numbers begin at 1")
    if a.maxpages:
        return sorted(set(wanted))[: a.maxpages] if wanted else list(range(1, a.maxpages + 1))
    return wanted


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    files, numbers = reader.open_files(spark, a.path, "*"), _numbers(a)
    table_settings = tables.TableSettings(vertical_strategy=a.vertical_strategy, horizontal_strategy=a.horizontal_strategy)
    if a.verb == "text":
        return verbs.extract_text(files, _settings(a), numbers, a.password, a.reconstruct)
    if a.verb in verbs.FORMATS:
        return verbs.extract_text_to(files, a.verb, _settings(a), a.password)
    if a.verb == "words":
        return verbs.extract_words(files, None, numbers, a.password)
    if a.verb == "tables":
        found = verbs.extract_tables(files, table_settings, numbers, password=a.password)
        if a.format == "csv":
            cells = found.select("doc_id", "page_no", "table", F.posexplode("rows").alias("row_index", "r")).select("doc_id", "page_no", "table", "row_index", F.posexplode("r").alias("column_index", "text"))
            return sinks.tables_csv(cells)
        return sinks.tables_json(found)
    if a.verb in ("chars", "shapes", "images"):
        rows = getattr(reader, a.verb)(files, password=a.password, numbers=numbers)
        return sinks.objects_csv(rows.drop("matrix", "color", "pts", "stroking_color", "non_stroking_color", "colorspace", "filters"), precision=a.precision) if a.format == "csv" else sinks.objects_json(rows, precision=a.precision)
    if a.verb == "objects":
        return reader.objects(files, a.codec, a.password)
    if a.verb == "trailer":
        return reader.objects(files, a.codec, a.password).filter("number = 0")
    if a.verb == "metadata":
        return reader.documents(files, a.password)
    if a.verb == "structure":
        return sinks.structure_json(reader.structure(files, password=a.password), reader.mcid_text(reader.chars(files, password=a.password)))
    give = {"outline": reader.outline, "embedded": reader.embedded_files, "annotations": reader.annotations, "labels": reader.page_labels}[a.verb]
    return give(files, password=a.password)


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("pagestrata").getOrCreate()
    out = run(spark, a)
    if a.out:
        kind = "parquet" if a.format == "parquet" else "json"
        out.write.mode("errorifexists").format(kind).save(a.out)
        return
    shown = [c for c in ("text", "html", "xml", "csv", "json", "line") if c in out.columns]
    for row in out.toLocalIterator(prefetchPartitions=True):
        print(row[shown[0]] if shown else row.asDict(recursive=True))


if __name__ == "__main__":
    main()
