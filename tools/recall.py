"""python tools/recall.py SF [COPIES]: recall of the neighbours against brute force over the rows of 1,500 drawn ids (500 of an enlarged collection), ties within 1e-9 counted as found.

With COPIES above 1 the collection is enlarged by so many copies of each vector, rotated anew for each copy, so that copies make new clusters, not denser ones.
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from memlake.llm import mih
from memlake.session import local_session


def main(sf: str, copies: int = 1) -> None:
    source = f"/root/testdata/{sf}/memories.parquet"
    table = pq.read_table(source, columns=["id", "embedding"])
    rows = [(i, v) for i, v in zip(table.column(0).to_pylist(), table.column(1).to_pylist()) if v is not None and None not in v and any(v)]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32)
    rng = np.random.default_rng(3)
    if copies > 1:
        parts = [x]
        for _ in range(copies - 1):
            turn = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0].astype(np.float32)
            parts.append(x @ turn)
        ids, x = np.array([f"{i}-{c}" for c in range(copies) for i in ids]), np.vstack(parts)
        source = f"/tmp/recall-{sf}-{copies}"
        os.makedirs(source, exist_ok=True)
        step = 200_000
        for n, at in enumerate(range(0, len(ids), step)):
            part = x[at : at + step]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.reshape(-1)))
            pq.write_table(pa.table({"id": ids[at : at + step], "embedding": lists}), f"{source}/{n}.parquet")
    drawn = rng.choice(len(ids), min(1500 if copies == 1 else 500, len(ids)), replace=False)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    found = mih.nearest_neighbours(spark.read.parquet(source), "id", "embedding")
    out = f"/tmp/recall-out-{os.getpid()}"
    found.write.parquet(out)
    took = time.time() - began
    ask = spark.createDataFrame([(str(ids[i]),) for i in drawn], "id string")
    got: dict[str, set[str]] = {}
    for r in spark.read.parquet(out).join(F.broadcast(ask), "id").collect():
        got.setdefault(r.id, set()).add(r.neighbour_id)
    place = {s: i for i, s in enumerate(ids)}
    unit = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
    hit = whole = 0
    for i in drawn:
        s = unit @ unit[i]
        s[i] = -2
        least = np.partition(s, -5)[-5]
        whole += 5
        hit += min(5, sum(s[place[n]] >= least - 1e-6 for n in got.get(ids[i], ())))
    print(f"{sf} x {copies}: {len(ids)} rows, recall {hit / whole:.4f}, {took:.0f} s")


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
