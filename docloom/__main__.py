"""Command line: documents of a collection to and from files of the compact text form.

    python -m docloom export ROOT DATABASE COLLECTION PATH
    python -m docloom import ROOT DATABASE COLLECTION PATH [--replace]
"""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("action", choices=["export", "import"])
    for name in ("root", "database", "collection", "path"):
        p.add_argument(name)
    p.add_argument("--replace", action="store_true", help="delete all other documents first")
    a = p.parse_args(args)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from docloom.sources.collections import Store
    from docloom.sources.toon_files import read_toon, write_toon

    spark = SparkSession.builder.getOrCreate()
    c = Store(spark, a.root).create_database(a.database).create_collection(a.collection)
    if a.action == "export":
        named = F.parse_json(F.to_json(F.struct("_id"))).cast("map<string,variant>")
        fields = F.map_filter(F.col("doc").cast("map<string,variant>"), lambda k, _: k != "_id")
        write_toon(c.frame().select(F.to_variant_object(F.map_concat(named, fields)).alias("doc")), a.path, a.collection)
        return 0
    rows = read_toon(spark, a.path)
    own = F.try_variant_get("doc", "$._id", "string")
    if a.replace:
        c.delete_many({})
    c.insert_many(rows.select(own.alias("_id"), "doc"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
