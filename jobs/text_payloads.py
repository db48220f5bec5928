"""Texts as segmented payloads: the raw export of messages that are longer than a frame.

    python -m jobs.text_payloads --source /in/documents.parquet --out /export --config jobs/text_payloads.json

Devices send texts (traces, notes, diagnostics) cut into frames, which the converter exports raw: on channels that no
catalog is bound to, with ids that some bound catalog knows. The job does that for a table of texts. A text without its
trailing NULs becomes as many frames of ``width`` bytes as its UTF-8 bytes need; its language gives the id, its doc_id the
channel. Tables of --out, both by channel, and replaced as a whole:

* ``payloads``: group_name, id, doc_id, part, dlc and data, padded with zeros to the longest of the channel;
* ``texts``: doc_id, id, n_bytes, n_frames, exported, and the digest of the bytes.

A rerun gives the same tables. Null and empty texts have no frames, and are in ``texts`` alone. Rows with a null doc_id go to
channel 0, those of a null or unknown language have the id ``other``. Repeated rows are exported as often as they
are there. A text is cut where it is read, and its frames go straight to the writer; the width of a channel comes from a
second reading of lengths alone. Frames are dealt by channel and a hash of doc_id and part, so that neither a hot channel nor a very long text
makes one task's file.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canloom.functions import bits
from canloom.functions.tables import local
from canloom.operators import frames as fr
from canloom.sources import dbc
from jobs.common import LOG, read_config, session, write


def messages(docs: DataFrame, config: dict) -> DataFrame:
    """doc_id, channel, arb_id and bytes of each text."""
    ids = F.create_map(*(F.lit(x) for lang, i in sorted(config["ids"].items()) for x in (lang, i)))
    arb_id = F.coalesce(F.try_element_at(ids, F.coalesce("lang", F.lit(""))), F.lit(config["other"])).cast("long")
    channel = F.coalesce(F.pmod("doc_id", F.lit(config["channels"])), F.lit(0)).cast("int")
    return docs.select("doc_id", channel.alias("channel"), arb_id.alias("arb_id"), F.encode(bits.clean_text(F.coalesce("text", F.lit(""))), "UTF-8").alias("bytes"))


def segments(texts: DataFrame, width: int) -> DataFrame:
    """The frames of texts, each with its place: seq is (doc_id, part)."""
    # the bytes as a lambda's variable: they are made once a text, and not once a slice
    slices = F.expr(f"flatten(transform(array(bytes), b -> transform(sequence(0, cast((octet_length(b) - 1) div {width} as int)), i -> substring(b, 1 + {width} * i, {width}))))")
    cut = texts.where("octet_length(bytes) > 0").select("doc_id", "channel", "arb_id", F.posexplode(slices).alias("part", "data"))
    no = F.lit(False)
    return cut.select(F.struct("doc_id", "part").alias("seq"), "channel", "arb_id", F.lit(0.0).alias("ts"), no.alias("is_extended"), F.lit(width > 8).alias("is_fd"), "data")


def run(spark: SparkSession, source: str, out: str, config: dict) -> dict[str, int]:
    """Export the texts at source; the rows of each table written."""
    texts = messages(spark.read.parquet(source), config)
    catalog = dbc.parse(config["catalog"], "texts.dbc")
    channels = config["channels"]
    # the texts' channels are unbound; one more is bound to the catalog, whose ids make frames known
    bound = local(spark, [*((c, None) for c in range(channels)), (channels, catalog.path)], "channel int, dbc string")
    known = dbc.messages_table(spark, [catalog])
    raw = fr.raw_frames(segments(texts, config["width"]), bound, known)
    groups = fr.raw_groups(raw).select("channel", "group_name", "id", "seq.doc_id", "seq.part", "dlc", "data")
    dealt = groups.repartition("channel", F.pmod(F.xxhash64("doc_id", "part"), F.lit(config["files_per_channel"])))
    n_bytes, width = F.expr("octet_length(bytes)").cast("long"), config["width"]
    exported = (n_bytes > 0) & F.col("arb_id").isin(sorted(catalog.messages))
    listed = texts.select("channel", "doc_id", F.col("arb_id").alias("id"), n_bytes.alias("n_bytes"), F.ceil(n_bytes / width).alias("n_frames"), exported.alias("exported"), F.sha2("bytes", 256).alias("sha256"))
    written = {"payloads": write(dealt, f"{out}/payloads", ["channel"], dynamic=False), "texts": write(listed, f"{out}/texts", ["channel"], dynamic=False)}
    LOG.info("read %d texts from %s, wrote %s", written["texts"], source, written)
    return written


def whole(spark: SparkSession, out: str) -> DataFrame:
    """Both tables as one: a text is the row of its part null."""
    payloads = spark.read.schema("group_name string, id long, doc_id long, part int, dlc int, data binary, channel int").parquet(f"{out}/payloads")
    texts = spark.read.schema("doc_id long, id long, n_bytes long, n_frames long, exported boolean, sha256 string, channel int").parquet(f"{out}/texts")
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    frames = payloads.select("doc_id", "channel", "id", "part", "group_name", F.col("dlc").cast("long").alias("size"), F.lower(F.hex("data")).alias("content"), nothing("boolean", "exported"))
    return frames.unionByName(texts.select("doc_id", "channel", "id", nothing("int", "part"), nothing("string", "group_name"), F.col("n_bytes").alias("size"), F.col("sha256").alias("content"), "exported"))


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("source", "out", "config"):
        p.add_argument(f"--{name}", required=True)
    args = p.parse_args()
    spark = session("text_payloads")
    try:
        run(spark, args.source, args.out, read_config(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
