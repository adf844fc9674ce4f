"""Conversation repair, hard negatives and archives against brute force."""

import base64
import gzip
import hashlib
import random
import re
import sys
import zlib
from functools import cache

import numpy as np
from compare import open_oracle

from fleetdrift.llm import conversations, negatives, warc
from fleetdrift.llm.storage import prepared, scratch

# --- conversation repair ---

BLANK = " \t\n\x0b\f\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def brute_repair(rows):
    """Cheapest edits by trying all, the least audit among them; rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        fault = None
        if not text.strip(BLANK):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(BLANK)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        faults.append(fault)

    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, fresh):
        """Least (cost, audit, rows) from row i on; ``fresh``: rows inserted just before, two at most."""
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if fresh < 2:
            for role in ("user", "assistant"):
                if role[0] in allowed[last]:
                    c, a, r = best(i, role[0], fresh + 1)
                    found.append((c + 3, "I" + a, (f"{role}:",) + r))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, last, 0)
            found.append((c + 4, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                if role[:1] and role[:1] in allowed[last]:
                    c, a, r = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}",) + r))
                for new in ("user", "assistant"):
                    if new[0] in allowed[last]:
                        c, a, r = best(i + 1, new[0], 0)
                        found.append((c + more + 3, "R" + a, (f"{new}:{text}",) + r))
        return min(found) if found else (1 << 30, "", ())

    sys.setrecursionlimit(20000)
    cost, audit, kept = best(0, "", 0)
    turns = {t for t, _, _ in rows if t is not None}
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(kept).encode()).hexdigest(),
    }


def brute_report(rows):
    damaged, found = brute_damage(rows), {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in damaged if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        found[conv] = brute_repair(own)
    return found


def check_report(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversations.repair_report(df, conversations.damaged(df), **sizes)
    found = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found.collect()}
    assert found == brute_report(rows)


def test_repair_of_short_conversations(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "tool", "user", "assistant", None, ""]
    texts = ["Yes.", "No", "", " \t", "Well! ", None, "Ä.", "a" * 70 + "1.", "a" * 70 + "2."]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 7)):
            at = rng.choice([turn] * 8 + [None, 3])
            rows.append((conv if conv else None, at, rng.choice(roles), rng.choice(texts)))
    rows += rows[:40]
    check_report(spark, rows)
    check_report(spark, rows, chunk_rows=2)


def test_repair_of_a_conversation_over_many_chunks(spark):
    rng = random.Random(2)
    rows = [(5, i, "user" if i % 2 else "assistant", f"t{rng.randint(0, 400)}{rng.choice('..x')}") for i in range(500)]
    rows += [(6, i, "assistant", f"{i}.") for i in range(90)] + [(7, 0, "system", "a.")] + [(8, None, "user", "same.")] * 300
    check_report(spark, rows, chunk_rows=16)


def test_speculative_costs_are_fixed_up():
    """Chunks started from another vector end as one pass over the whole does."""
    rng = random.Random(3)
    codes = bytes(rng.choice([0, 1, 2, 3, 6, 7, 8]) for _ in range(200))
    whole = conversations.backward(codes, conversations._pack(conversations.END))
    for cut in (1, 77, 199):
        right = conversations.backward(codes[cut:], int(whole[-1]))
        guess = conversations.backward(codes[:cut], conversations._pack((9, 0, 5, 1)))
        left = conversations.backward(codes[:cut], int(right[0]), guess)
        assert [*left[:-1], *right] == whole.tolist()


def test_repaired_rows_and_edits(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Who?"), (1, 2, "assistant", "Me")]
    repair = conversations.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kept = [(r.role, r.text, r.edit) for r in repair.repaired().orderBy("place", "step").collect()]
    report = repair.reports().first()
    assert (report.audit, report.cost) == ("KIKK", 6)
    assert kept == [("user", "Hi.", "K"), ("assistant", "", "I"), ("user", "Who?", "K"), ("assistant", "Me", "K")]
    edits = "".join(r.edit for r in repair.edits().orderBy("place", "step").collect())
    assert edits == report.audit


def test_repair_of_nothing_and_extra_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, place int, chunk int, hash string")
    assert conversations.repair_report(empty, conversations.damaged(empty)).count() == 0
    one = spark.createDataFrame([(None, None, None, None, 1)], "conv_id long, turn long, role string, text string, audit int")
    found = conversations.repair_report(one, conversations.damaged(one)).collect()
    assert [(r.conv_id, r.audit.strip("D"), r.gaps) for r in found] == [(None, "", 0)]


def test_repair_of_the_given_table(spark, small):
    rows = open_oracle(small).sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    check_report(spark, rows)


# --- hard negatives ---


def brute_negatives(rows, is_anchor, k=5):
    """(vec_id, label, vector) rows, scored with Python's integers."""
    held = {}
    for vec_id, label, vector in sorted((r for r in rows if None not in r and None not in r[2]), key=repr):
        if all(np.isfinite(256 * x) for x in vector):
            key = (label, list(vector))
            if vec_id not in held or key < held[vec_id]:
                held[vec_id] = key
    whole = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, (label, v) in held.items()}
    out = set()
    for a, (own, q) in whole.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, label) for i, (label, v) in whole.items() if i != a and len(v) == len(q))
        for s, positive, _ in [r for r in scored if r[2] == own][:k]:
            hits = [(n, i) for n, i, label in scored if label != own and 80 * -s <= 100 * -n <= 100 * -s]
            for rank, (n, i) in enumerate(hits[:k], 1):
                if abs(s) < 1 << 63:
                    out.add((a, positive, rank, i, -s, -n))
    return out


def mined(spark, rows, **sizes):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **sizes).collect()
    return {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found}, len(found)


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 8))
    rows = [(i, int(rng.integers(0, 3)), (centres[i % 5] + 0.3 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(300 + i, i % 2, centres[0].tolist()) for i in range(60)]  # equal vectors, ties
    rows += [(400, 1, [0.0] * 8), (401, 1, [1.0, 2.0]), (410, 1, [2.0, 1.0]), (402, 0, [1.0, 1.5]), (420, 1, [])]
    rows += [(500, None, centres[0].tolist()), (510, 1, None), (520, 1, [None] * 8), (530, 1, [float("nan")] * 8), (None, 1, centres[1].tolist())]
    rows += rows[:20] + [(3, 0, centres[2].tolist())]
    for sizes in ({}, {"block_rows": 16, "slice_anchors": 7, "part_blocks": 3}):
        found, n = mined(spark, rows, **sizes)
        assert found == brute_negatives(rows, lambda a: a % 10 == 0) and n == len(found)


def test_hard_negatives_of_very_long_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, (rng.normal(size=4) * 10.0 ** (i % 30)).tolist()) for i in range(120)]
    found, _ = mined(spark, rows, block_rows=32)
    assert found == brute_negatives(rows, lambda a: a % 10 == 0)


def test_bounds_hold_and_filter():
    """Every score lies within the bounds of its block, and narrow windows leave blocks out."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    points = np.floor(256 * np.vstack([rng.normal(size=(40, 6)) * 0.01 + c for c in np.eye(6)]))
    to = negatives.references(points)
    norms = np.linalg.norm(points, axis=1)
    angles = np.arccos(np.clip(points @ to.T / norms[:, None], -1, 1))
    parts = [slice(i, i + 40) for i in range(0, 240, 40)]
    blocks = pa.table({
        "least": [angles[p].min(0).tolist() for p in parts], "most": [angles[p].max(0).tolist() for p in parts],
        "shortest": [norms[p].min() for p in parts], "longest": [norms[p].max() for p in parts], "labels": [[1]] * 6,
    })
    low = int(0.8 * norms[0] ** 2)
    anchors = pa.table({"label": [1], "norm": [norms[0]], "angles": [angles[0].tolist()], "lows": [[low]], "highs": [[1 << 40]]})
    _, met = negatives._met(anchors, blocks, True, 6)
    needed = {i for i, p in enumerate(parts) if (points[p] @ points[0]).max() >= low}
    assert needed <= set(met.tolist()) and len(met) < 6


def test_hard_negatives_of_nothing(spark):
    assert mined(spark, [])[1] == 0
    assert mined(spark, [(0, 1, [1.0])])[1] == 0


# --- archives ---


def brute_archive(pages):
    groups = {}
    for p in pages:
        groups.setdefault(p[2] or "", []).append(p)
    out = []
    for payload, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
        raw = payload.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        for i, r in enumerate(rows):
            out.append((r[0], len(raw), digest, "revisit" if i else "response", rows[0][0] if i else None))
    return sorted(out, key=repr)


PAGES = [
    (1, "http://a/1", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, "http://a/2", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (0, None, "<p>é\r\n\r\nWARC/1.1\r\n</p>"),
    (3, "http://b/\r\nX: y", ""), (4, None, None), (4, None, None), (5, "u", "x" * 3_000_000), (5, "u", "x" * 3_000_000), (None, "v", "lone"),
    (None, None, "lone"), (7, "z", "lone"), (8, "q", "\U0001f600"), (9, "only", "one"),
]


def archived(spark, pages, **options):
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = scratch(spark)
    warc.write_archives(warc.page_records(rows), path, **options)
    return path


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_archives_resolve_to_all_pages(spark):
    path = archived(prepared(spark), PAGES, records_per_file=3)
    read = warc.read_archives(spark, path)
    assert rows_of(warc.resolved(read)) == brute_archive(PAGES)
    payloads = {r.page_id: bytes(r.payload).decode() for r in read.where("record_type = 'response'").collect()}
    assert payloads == {0: PAGES[0][2], 3: "", 5: PAGES[6][2], 7: "lone", 8: "\U0001f600", 9: "one"}
    assert read.select("record_id").distinct().count() == len(PAGES)
    assert {r.url for r in read.where("page_id = 3").collect()} == {"http://b/  X: y"}


def test_files_are_archives_by_the_standard(spark, tmp_path):
    path = archived(spark, PAGES)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    records = [r for f in files for r in warc.parse_archive(bytes(f.content))]
    assert len(records) == len(PAGES)
    for head, block in records:
        assert int(head["content-length"]) == len(block) and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", head["warc-record-id"])
        assert (head["warc-type"] == "revisit") == ("warc-profile" in head)
        if head["warc-type"] == "response":
            body = block.partition(b"\r\n\r\n")[2]
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert head["warc-payload-digest"] == f"sha1:{digest}"


def test_archives_of_many_members_and_plain_ones():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\na\r\n\r\n\r\n\r\n"[:-4].replace(b"a\r\n\r\n", b"ab\r\n") + b"\r\n\r\n"
    expected = [({"warc-type": "response", "content-length": "4"}, b"ab\r\n")] * 3
    assert list(warc.parse_archive(record * 3)) == expected
    assert list(warc.parse_archive(gzip.compress(record) * 3)) == expected
    assert list(warc.parse_archive(b"")) == []


def test_archives_with_revisits_are_written_anew(spark):
    """A second pass joins the revisits of earlier archives with pages crawled later."""
    first = archived(spark, PAGES)
    late = spark.createDataFrame([(-1, "late", "lone"), (20, "new", "new")], "page_id long, url string, html string")
    both = warc.archive_records(warc.read_archives(spark, first)).unionByName(warc.page_records(late))
    second = scratch(spark)
    warc.write_archives(both, second)
    found = rows_of(warc.resolved(warc.read_archives(spark, second)))
    assert found == brute_archive([*PAGES, (-1, "late", "lone"), (20, "new", "new")])
    responses = [r for r in found if r[3] == "response"]
    assert len(responses) == len({r[2] for r in found}) == 7
    assert {r[4] for r in found if r[1] == 4 and r[3] == "revisit"} == {-1}


def test_small_payloads_are_never_revisited(spark):
    path = archived(spark, PAGES, least_bytes=5)
    found = rows_of(warc.resolved(warc.read_archives(spark, path)))
    assert len(found) == len(PAGES)
    assert all(r[3] == "response" for r in found if r[1] < 5) and sum(r[3] == "revisit" for r in found) == 3


def test_archives_of_nothing(spark):
    path = archived(spark, [])
    assert warc.resolved(warc.read_archives(spark, path)).count() == 0
    odd = spark.createDataFrame([(1, "u", "a", 5, "x")], "page_id long, url string, html string, payload int, record_id string")
    assert warc.deduplicated(warc.page_records(odd)).count() == 1
