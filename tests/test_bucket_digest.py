"""The digest of any number of files by buckets, against hashlib."""

from collections import defaultdict
from hashlib import sha256

from plumbline.functions import naming


def test_digest_by_buckets(spark):
    files = [(k, f"file_{i}", i * 7 % 31) for k, n in (("a", 9000), ("b", 3)) for i in range(n)]
    rows = spark.createDataFrame([*files, ("b", None, 1), ("b", "no size", None)], "lang string, name string, size long")
    got = {r.lang: r.digest for r in naming.bucket_digest(rows.repartition(5), ["lang"], "name", "size").collect()}
    for key in ("a", "b"):
        buckets = defaultdict(list)
        for k, name, size in files:
            if k == key:
                buckets[sha256(name.encode()).hexdigest()[:3]].append((name, size))
        lines = "".join(f"{b}:{sha256(''.join(f'{n}:{s}\n' for n, s in sorted(x)).encode()).hexdigest()}\n" for b, x in sorted(buckets.items()))
        assert got[key] == sha256(lines.encode()).hexdigest()
