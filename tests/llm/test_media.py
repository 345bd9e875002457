import hashlib
import json
import struct
import zlib

import pytest
from conftest import ODD

from ledgerloom.llm import media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 12, 576 * 12 + 1, 576 * 100])
def test_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and payload[:n] == data and set(payload[n:]) <= {255} and len(payload) == max(576, -(-n // 576) * 576)
    file = media.write_container(payload)
    feature, chunks = media.read_container(file)
    assert media.payload_of(file, chunks) == payload
    frames = len(payload) // 576
    assert feature["codec"] == "raw" and feature["frames"] == feature["duration"] == frames and len(feature["keyframes"]) == -(-frames // 12)
    for k, (at, size) in enumerate(feature["keyframes"]):
        assert file[at : at + size] == payload[k * 12 * 576 : k * 12 * 576 + 576]


def test_box_sizes():
    file = media.write_container(media.padded(b"abc"))
    at = file.index(b"mdat") - 4
    size = struct.unpack_from(">I", file, at)[0]
    moov, rest = file[at + size :], file[: at + size]
    wide = rest[:at] + moov + struct.pack(">I4sQ", 1, b"mdat", size + 8) + rest[at + 8 :]  # 64-bit size, data at the end
    last = rest[:at] + moov + struct.pack(">I4s", 0, b"mdat") + rest[at + 8 :]  # up to the end
    for data in (wide, last):
        assert [p[-1] for p, _, _ in media.boxes(memoryview(data)) if len(p) == 1] == [b"ftyp", b"moov", b"mdat"]
    with pytest.raises(ValueError):
        list(media.boxes(memoryview(file[:-5])))


def full(kind, *parts, flags=0):
    body = struct.pack(">I", flags) + b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def wrapped(kind, *parts):
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def test_duration_is_that_of_the_samples():
    payload = media.padded(bytes(576 * 30))
    file = bytearray(media.write_container(payload))
    at = file.index(b"stts") + 8
    assert struct.unpack_from(">III", file, at) == (1, 30, 1)
    struct.pack_into(">I", file, at + 8, 7)  # each sample lasts 7, the headers still say 30 in all
    feature, _ = media.read_container(bytes(file))
    assert feature["duration"] == 210 and feature["keyframe_times"] == [0, 84, 168]
    struct.pack_into(">I", file, at + 4, 29)
    with pytest.raises(ValueError):
        media.read_container(bytes(file))


@pytest.mark.parametrize("moof_is_base", [True, False])
def test_fragments(moof_is_base):
    """The first frames are in the file's own tables, 3 and 2 more follow in fragments, beside those of another track."""
    payload = media.padded(bytes(i % 253 for i in range(576 * 2)))
    head = media.write_container(payload)
    first, more, other = bytes([1]) * 30, bytes([2]) * 50, bytes([3]) * 11

    def fragment(at, data, size, trun):
        for _ in range(2):  # the second time with the offset known
            header = full(b"tfhd", struct.pack(">I", 1), *([] if moof_is_base else [struct.pack(">Q", at)]), struct.pack(">III", 40, size, media.NOT_KEY), flags=0x38 | (0x20000 if moof_is_base else 1))
            foreign = wrapped(b"traf", full(b"tfhd", struct.pack(">I", 2), flags=0x20000), full(b"trun", struct.pack(">II", 1, len(other)), flags=0x200))
            moof = wrapped(b"moof", full(b"mfhd", struct.pack(">I", 1)), foreign, wrapped(b"traf", header, trun(len(trun_at) and trun_at[-1])))
            trun_at.append(len(moof) + 8)
        return moof + wrapped(b"mdat", data)

    trun_at = []
    one = fragment(len(head), first, 10, lambda o: full(b"trun", struct.pack(">Ii", 3, o), struct.pack(">I", 0), flags=0x5))
    trun_at = []
    two = fragment(len(head) + len(one), more, 99, lambda o: full(b"trun", struct.pack(">Ii", 2, o), struct.pack(">IIIIII", 5, 20, media.NOT_KEY, 6, 30, 0), flags=0x701))
    file = head + one + two
    feature, chunks = media.read_container(file)
    assert media.payload_of(file, chunks) == payload + first + more
    assert feature["frames"] == 7 and feature["duration"] == 2 + 3 * 40 + 5 + 6
    assert [file[a : a + n] for a, n in feature["keyframes"]] == [payload[:576], first[:10], more[20:]] and feature["keyframe_times"] == [0, 2, 127]


def brute(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_odd_rows(docs):
    got = media.probe_media(media.store_media(docs(ODD))).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=str) == sorted(((r[0], *brute(r[1])) for r in ODD), key=str)
    same = {tuple(r)[1:] for r in got if r["doc_id"] in (4, 5)}
    assert len(same) == 1 and all(json.loads(r["feature"])["frames"] * 576 == r["payload_bytes"] for r in got)
    assert media.probe_media(media.store_media(docs([]))).count() == 0
