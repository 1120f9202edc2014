"""op11: round trips against a plain rule and the query's SQL, and damaged archives."""

import gzip
import hashlib
import random

import duckdb
import pytest

from genoflux.llm.warc import EMPTY_MEMBER, Gap, Record, member, salvaged

SCHEMA = "page_id long, url string, html string"


def pages(n=60, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        html = rng.choice([None, "", "short", "x" * 99, "y" * 100, "same " * 50, "same " * 50, f"<p>é {i}</p>" * rng.randint(1, 300), "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "\r\n\r\n" * 40])
        out.append((rng.choice([i, i, i, None, 5]), rng.choice([None, "", f"http://h/{i}", "http://a\r\nContent-Length: 3", "u" * 3000]), html))
    return out + out[:5]


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        least = first.get(html or "")
        again = len(data) >= 100 and least is not None and page_id != least
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 60])
def test_round_trip(spark, n):
    from genoflux.llm.warc import archived

    rows = pages(n)[: n and n + 5]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as digest", "'y' as record", "1 as salt", "2 as refers_to").repartition(3)
    assert got(archived(df)) == brute(rows)


@pytest.mark.parametrize("compressed", [True, False])
def test_files_hold_all_payloads(spark, tmp_path, compressed):
    from genoflux.llm.warc import read_archives, write_archives

    rows = pages()
    write_archives(spark.createDataFrame(rows, SCHEMA).repartition(2), f"{tmp_path}/w", compressed, file_bytes=5000)
    files = sorted(tmp_path.glob("w/part-*"))
    data = [f.read_bytes() for f in files]
    assert len(files) > 4 and all((gzip.decompress(d) if compressed else d).startswith(b"WARC/1.1\r\n") for d in data if d)
    back = read_archives(spark, f"{tmp_path}/w").where("record_type = 'response'").collect()
    want = brute(rows)
    assert sorted(hashlib.sha256(r.payload).hexdigest() for r in back) == sorted(w[2] for w in want if w[3] == "response")
    assert {r.target_uri for r in back} <= {u and u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in rows}
    assert all(r.kind == "record" and r.payload_digest == hashlib.sha256(r.payload).hexdigest() for r in back)
    # a file cut short and one with a damaged byte: what is lost is logged, and nothing else is
    files[0].write_bytes(data[0][:-7])
    broken = bytearray(data[1])
    broken[len(broken) // 2 if compressed else data[1].rindex(b"HTTP/1.1")] ^= 0xFF
    files[1].write_bytes(broken)
    for crc in tmp_path.glob("w/.*.crc"):
        crc.unlink()
    again = read_archives(spark, f"{tmp_path}/w").collect()
    gaps = [r for r in again if r.kind == "gap"]
    assert len(gaps) == 2 and all(g.reason and g.length > 0 for g in gaps)
    assert len(again) - len(gaps) in (len(want) - 1, len(want) - 2)  # the cut may have taken an empty member only


def test_query_against_sql(spark):
    from genoflux.llm import op11

    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.001/pages.parquet')")
    assert got(op11.op11_warc(spark, "/root/testdata/sf0.001")) == sorted(con.execute(op11.SQL).fetchall(), key=repr)


def plain(i, body):
    digest = hashlib.sha256(body).hexdigest()
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def ids(found):
    shown = [r.headers["warc-record-id"][1:-1] for r in found if isinstance(r, Record)]
    return [int(x) if x in map(str, range(20)) else x for x in shown]  # nothing guards a plain record's headers


@pytest.mark.parametrize("kind", ["plain", "members", "mixed"])
def test_salvage_of_damaged_files(kind):
    """Every record that no damage touches comes back, none that damage touched does, and records and gaps tile the file."""
    rng = random.Random(kind)
    for trial in range(150):
        parts, at = [], 0
        for i in range(12):
            r = plain(i, bytes(rng.choice(b"ab\r\nWARC/1.0") for _ in range(rng.randint(0, 200))))
            if kind == "members" or kind == "mixed" and rng.random() < 0.5:
                r = member(r) + (EMPTY_MEMBER if rng.random() < 0.5 else b"")
            parts.append((at, r))
            at += len(r)
        data = bytearray(b"".join(r for _, r in parts))
        hit = set()
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(data))
            data[p] ^= rng.randint(1, 255)
            hit.add(p)
        cut = rng.randrange(len(data)) if rng.random() < 0.3 else len(data)
        found = list(salvaged(bytes(data[:cut])))
        clean = {i for i, (b, r) in enumerate(parts) if b + len(r) <= cut and not any(b <= p < b + len(r) for p in hit)}
        assert clean <= set(ids(found)) and (kind != "members" or len(ids(found)) == len(set(ids(found))) and set(ids(found)) <= set(range(12)))
        assert all(x.offset + x.length <= y.offset for x, y in zip(found, found[1:]))
        covered = sum(x.length for x in found)
        assert covered + 20 * 12 >= cut and (kind != "plain" or covered == cut)  # empty members are in neither
        if not hit and cut == len(data):
            assert ids(found) == list(range(12)) and not any(isinstance(x, Gap) for x in found)


def test_gaps_say_what_failed():
    good = plain(1, b"abc")
    cases = {
        "no version line": b"junk",
        "payload-digest differs": good.replace(b"abc", b"abd"),
        "record without its two line ends": good[:-4] + b"\r\n\r\r",
        "header without type, id or length": good.replace(b"Content-Length", b"Other-Length"),
        "header line without a colon": good.replace(b"WARC-Type: ", b"WARC-Type "),
        "damaged member": member(good)[:12] + b"\xff\xff\xff" + member(good)[15:],
    }
    for reason, bad in cases.items():
        found = list(salvaged(good + bad + plain(2, b"") + member(plain(3, b"z"))))
        assert ids(found) == [1, 2, 3]
        (gap,) = [x for x in found if isinstance(x, Gap)]
        assert (gap.reason, gap.offset, gap.length) == (reason, len(good), len(bad))
    assert list(salvaged(b"")) == [] and [g.reason for g in salvaged(member(good)[:-3])] == ["member beyond the end"]
    assert [g.reason for g in salvaged(b"WARC/1.1\r\nA: b\r\n")] == ["header without end"]


@pytest.mark.parametrize("data", [b"WARC/1.1\r\n" * 300_000, b"WARC/1.1\r\nA: b\r\n" * 100_000 + b"\r\n\r\n", b"\x1f\x8b\x08" * 300_000, b"\r\n\r\n" * 300_000])
def test_long_junk_is_one_gap(data):
    (gap,) = salvaged(data)
    assert (gap.offset, gap.length) == (0, len(data))
