"""Addresses as expressions against Python's own reader of addresses."""

import random

from pyspark.sql import functions as F

from quirespark.functions import addresses as A
from quirespark.operators import shapes as S
from quirespark.plans import form_queries as Q

FIXED = ("8.8.8.8", "10.1.2.3", "100.64.0.9", "192.88.99.1", "::ffff:240.0.0.1", "2606:4700::1111", "2001:db8::1%eth0", "::c0a8:101%eth0", "fe80::1", "fec0::1", "not one", "1.2.3", "3fff::1", "64:ff9b::7f00:1", "172.32.0.1", "2a00:1450::1%9", "255.255.255.255", "fd00::1", "", ":", "::", "::1", "1::", ":::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "::2:3:4:5:6:7:8", "1::2::3", "::ffff:8.8.8.8", "64:ff9b::8.8.8.8", "2606::1.2.3.4", "2606::1.2.3", "01.2.3.4", "1.2.3.4%e", "12345::", "FE80::A", "2001:20::", "2001:30::", "100::1", "100:0:0:1::1", "64:ff9b:1::", "g::1", " 8.8.8.8")


def test_routable(spark):
    r = random.Random(1)
    made = [".".join(str(r.choice([0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 8, r.randrange(270)])) for _ in range(4)) for _ in range(400)]
    made += [":".join(r.choice(["", "0", "2001", "ffff", "64", "fe8", "1", "db8"]) for _ in range(r.randrange(2, 10))) for _ in range(600)]
    made += [r.Address for r in Q.addresses(spark, "/root/testdata/sf0.001").selectExpr("address AS Address").collect()]
    frame = spark.createDataFrame([(a,) for a in (*FIXED, *made, None)], "a string")
    for row in frame.select("a", A.routable(F.col("a")).alias("ok")).collect():
        assert row.ok == (S.routable(row.a) if row.a is not None else False), row.a
