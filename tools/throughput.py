"""python tools/throughput.py [MB] [CPUS]: chunking, hashing with encoding, and decoding of synthetic BF16 and F32 weights.

The weights are normal with standard deviation 0.02, made on the workers; nothing is stored. Times are of whole Spark jobs."""

import json
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from chunklake.functions import chunker, codec
from chunklake.plans import pipeline

MB = int(sys.argv[1]) if len(sys.argv) > 1 else 512
CPUS = int(sys.argv[2]) if len(sys.argv) > 2 else 8
PIECE = 1 << 22


def weights(dtype: str, seed: int) -> bytes:
    x = np.random.default_rng(seed).normal(0, 0.02, PIECE // codec.WIDTHS[dtype]).astype("<f4")
    return (x.view("<u4") >> 16).astype("<u2").tobytes() if dtype == "bf16" else x.tobytes()


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out = {"mb": MB, "cpus": CPUS}
    raw = weights("bf16", 1)
    chunker.cuts(raw)
    began = time.time()
    for _ in range(16):
        chunker.cuts(raw)
    out["chunking_one_core_mb_s"] = round(16 * PIECE / 1e6 / (time.time() - began))
    for dtype in ("bf16", "f32"):

        def make(batches, dtype=dtype):
            for b in batches:
                for i in b.column(0).to_pylist():
                    data = weights(dtype, i)
                    spans = chunker.chunk(data, [(0, len(data), dtype)])
                    yield pa.RecordBatch.from_arrays([pa.array([f"{i}-{a}" for a, _, _ in spans]), pa.array([dtype] * len(spans)), pa.array([data[a:z] for a, z, _ in spans], pa.binary())], ["hash", "dtype", "raw"])

        n = max(CPUS, MB * 10**6 // PIECE)
        pieces = spark.range(0, n, 1, CPUS).mapInArrow(make, schema="hash string, dtype string, raw binary").persist()
        total = pieces.agg(F.sum(F.octet_length("raw"))).first()[0]

        def encode(batches):
            import hashlib

            for b in batches:
                raws = b.column(2).to_pylist()
                blobs = [codec.encode(r, t) for r, t in zip(raws, b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(r).hexdigest() for r in raws]), pa.array([len(r) for r in raws], pa.int64()), pa.array(blobs, pa.binary())], ["hash", "raw_len", "blob"])

        blobs = pieces.mapInArrow(encode, schema="hash string, raw_len long, blob binary").persist()
        began = time.time()
        stored = blobs.agg(F.sum(F.octet_length("blob"))).first()[0]
        out[f"{dtype}_hash_encode_mb_s"] = round(total / 1e6 / (time.time() - began))
        began = time.time()
        good = pipeline.decode(blobs).agg(F.count_if("ok"), F.count(F.lit(1))).first()
        assert good[0] == good[1]
        out[f"{dtype}_decode_verify_mb_s"] = round(total / 1e6 / (time.time() - began))
        sample = weights(dtype, 1)
        cut = [sample[a:z] for a, z, _ in chunker.chunk(sample, [(0, len(sample), dtype)])]
        out[f"{dtype}_zstd_pct"] = round(100 * sum(len(codec.encode(c, "raw")) for c in cut) / len(sample), 1)
        out[f"{dtype}_pipeline_pct"] = round(100 * stored / total, 1)
        blobs.unpersist()
        pieces.unpersist()
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
