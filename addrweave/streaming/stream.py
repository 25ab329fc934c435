"""Addresses that arrive, matched against versions of the locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import MatchConfig
from ..operators.match import best_match, find_candidates
from ..operators.parse import parse_addresses
from ..sources.tables import read_addresses
from ..storage import new_folder, scratch, stored
from .snapshot import latest, publish


def match_stream(arriving: DataFrame, locations: DataFrame | str, path: str, checkpoint: str, config: MatchConfig = MatchConfig(), once: bool = True) -> StreamingQuery:
    """Match each micro-batch of (record_id, raw_address) and write it under ``path``.

    ``locations`` are parsed locations, of which an index is built once before the
    stream starts, or the folder of published versions; each batch reads the newest
    version that is whole when it begins, and says which in ``version``.  A batch
    reads stored tables only.

    Each batch goes to a folder of its own, so a repeated batch overwrites its
    earlier try and every record is written once.
    """
    if not isinstance(locations, str):
        root = new_folder(arriving.sparkSession)
        publish(locations, root)
        locations = root

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version, index = latest(spark, locations)
        with scratch(spark):
            addresses = stored(parse_addresses(read_addresses(batch), "address"))
            best = best_match(addresses, find_candidates(addresses, index, config)).withColumn("version", F.lit(version))
            best.select("record_id", "location_id", "confidence", "selected_strategy", "selected_confidence", "version").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
