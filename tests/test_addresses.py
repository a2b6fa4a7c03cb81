import random

from tessera.functions import scalars as S
from tessera.functions.udfs import blocked_ip_one, percent_decode_one


def test_addresses_equal_the_standard_parser(spark):
    rng = random.Random(9)
    cases = ["::", "::1", "1::", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::8.8.8.8", "::127.0.0.1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::",
             "12345::", "g::", "", ":", "2002:a00:1::", "2002:808:808::", "64:ff9b::10.1.2.3", "64:ff9b::8.8.8.8", "64:ff9b:1::1", "fe80::1", "febf::", "fec0::", "fc00::", "fdff:ffff::", "ff02::1", "2001::1", "2001:db8::1", "2001:db9::", "2606:4700::1111",
             "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "::01.2.3.4", "10.0.0.1", "8.8.8.8", "8.8.8.8\n", "::1\n", "FE80::ABCD", "0:0:0:0:0:ffff:c0a8:101", "0:0:0:0:0:0:c0a8:101", "1.2.3", "x"]
    for _ in range(400):
        parts = [f"{rng.choice([0, 0, 1, 0x64, 0xff9b, 0x2002, 0x7f00, rng.randrange(65536)]):x}" for _ in range(8)]
        text = ":".join(parts)
        if rng.random() < 0.5:
            a, b = sorted(rng.sample(range(9), 2))
            text = ":".join(parts[:a]) + "::" + ":".join(parts[b:])
        cases.append(text)
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "ip string")
    got = {r.ip: r.b for r in df.select("ip", S.blocked_ip("ip").alias("b")).collect()}
    assert {c: got[c] for c in cases} == {c: blocked_ip_one(c) for c in cases} and got[None] is None


def test_percent_decoding_equals_the_byte_loop(spark):
    rng = random.Random(4)
    cases = ["", "%", "%%", "%2", "%2F", "%2f%41", "a%20b+c", "%zz%25", "%C3%A9", "%c3", "é%e4%b8%ad", "%25%32%46", "100%", "%\n41", "%4", "x%E2%28%A1y", "%00"]
    cases += ["".join(rng.choice(["%", "2", "F", "a", "G", "é", "%41", "%c3%a9", "%ff"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "t string")
    got = {r.t: r.d for r in df.select("t", S.percent_decoded("t").alias("d")).collect()}
    assert {c: got[c] for c in cases} == {c: percent_decode_one(c) for c in cases} and got[None] is None
