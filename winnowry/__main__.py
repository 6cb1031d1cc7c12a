"""python -m winnowry [options] PATH: main content of HTML files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from winnowry import sources
from winnowry.functions import stopwords
from winnowry.operators import classify, paragraphs
from winnowry.plans import output
from winnowry.session import prepare


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="winnowry", description=__doc__)
    p.add_argument("path")
    p.add_argument("-o", "--output", help="folder for text files; else standard output")
    p.add_argument("-s", "--stoplist", default="english", help="language, or None")
    p.add_argument("--stoplist-file")
    p.add_argument("--format", choices=["default", "boilerplate", "detailed", "krdwrd"], default="default")
    p.add_argument("--encoding")
    p.add_argument("--default-encoding", default="utf8")
    p.add_argument("--errors", default="replace", choices=["strict", "replace", "ignore"])
    for name, kind in (("max_link_density", float), ("length_low", int), ("length_high", int), ("stopwords_low", float), ("stopwords_high", float), ("max_heading_distance", int)):
        p.add_argument("--" + name.replace("_", "-"), type=kind)
    p.add_argument("--no-headings", action="store_true")
    p.add_argument("--list-stoplists", action="store_true")
    a = p.parse_args(argv)
    spark = prepare(SparkSession.builder.appName("winnowry").getOrCreate())
    stop = stopwords.from_file(spark, a.stoplist_file) if a.stoplist_file else [] if a.stoplist == "None" else stopwords.words(a.stoplist)
    given = {k: v for k, v in vars(a).items() if k in classify.Thresholds.__dataclass_fields__ and v is not None}
    pages = sources.binary_files(spark, a.path, a.encoding, a.default_encoding, a.errors)
    rows = classify.classify(paragraphs.from_pages(pages, variants=False), stop, None, classify.Thresholds(**given))
    form = {"default": output.default, "boilerplate": lambda r: output.default(r, True), "detailed": output.detailed, "krdwrd": output.krdwrd}[a.format]
    lines = form(rows).orderBy("page_id", "idx").select("line")
    if a.output:
        lines.write.text(a.output)
    else:
        for r in lines.toLocalIterator():
            print(r.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
