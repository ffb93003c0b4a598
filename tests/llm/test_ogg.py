import random
import struct

from ruleweave.llm import ogg


def slow_crc(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def test_checksum_equals_the_bitwise_definition():
    rng = random.Random(0)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_crc(data)


def test_round_trip_of_all_packet_borders():
    rng = random.Random(1)
    for n in (64, 510 * 64, 2 * ogg.PACKET * 12, 64 * 1000, 64 * 9999):
        payload = rng.randbytes(n)
        got, feature, times, problems, gaps = ogg.read_media(ogg.write_media(payload))
        assert got == payload and not problems and not gaps and feature
        for c in range(ogg.CHANNELS):
            own = [(s, b) for ch, s, b in times if ch == c]
            at = 0
            for seconds, size in own:
                at += size
                assert abs(seconds - at / ogg.RATE) < 1e-9
            assert at == n // ogg.CHANNELS


def test_packets_of_lacing_multiples_and_over_pages():
    packets = [(b"h", 0), (b"", 0), (b"x" * 255, 255), (b"y" * 510, 765), (b"z" * 255 * 300, 765 + 255 * 300), (b"end", 768 + 255 * 300)]
    pages = ogg.pages_of(9, packets)
    streams, good, problems = ogg.read_pages(b"".join(pages))
    assert [p for p, _ in streams[9].packets] == [p for p, _ in packets] and good == len(pages) and not problems
    assert any(struct.unpack_from("<B", p, 5)[0] & ogg.CONTINUED for p in pages)


def undamaged(payload, gaps):
    """Places of the payload that lie in no gap."""
    keep = bytearray(b"\1" * len(payload))
    for channel, start, length in gaps:
        keep[channel + ogg.CHANNELS * start : channel + ogg.CHANNELS * (start + length) : ogg.CHANNELS] = bytes(length)
    return [i for i, k in enumerate(keep) if k]


def test_damage_is_found_and_the_rest_is_read():
    payload = random.Random(2).randbytes(64 * 8000)
    whole = ogg.write_media(payload)
    for at in (len(whole) // 2, len(whole) // 3, len(whole) - 10):
        media = bytearray(whole)
        media[at] ^= 1
        got, _, times, problems, gaps = ogg.read_media(bytes(media))
        assert any("checksum" in p for p in problems) and len(times) > 10 and len(got) == len(payload)
        kept = undamaged(payload, gaps)
        assert all(got[i] == payload[i] for i in kept) and 0.8 * len(payload) < len(kept) < len(payload)
        assert all(not got[c + 2 * i] for c, start, n in gaps for i in (start, start + n - 1))
    got, _, _, problems, gaps = ogg.read_media(whole[: len(whole) // 3])
    kept = undamaged(payload, gaps)
    assert len(got) == len(payload) and all(got[i] == payload[i] for i in kept) and len(kept) > 0.2 * len(payload) and any("no last page" in p for p in problems)
    assert ogg.read_media(b"junk")[3] and ogg.read_media(b"")[3] and ogg.read_media(None)[3] == ["no data"]


def test_a_channel_without_its_header_is_a_gap():
    payload = random.Random(4).randbytes(64 * 500)
    whole = bytearray(ogg.write_media(payload))
    whole[30] ^= 1  # in the first page, the header of one channel
    got, _, _, problems, gaps = ogg.read_media(bytes(whole))
    assert len(gaps) == 1 and gaps[0][1:] == (0, len(payload) // 2) and problems
    other = 1 - gaps[0][0]
    assert got[other::2] == payload[other::2] and not any(got[gaps[0][0] :: 2])


def test_operator_over_nulls_copies_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, "m"), (2, "", "m"), (3, "é" * 40, "m"), (3, "é" * 40, "m"), (None, "a" * 64, "m")], "doc_id long, text string, media string")
    got = ogg.read_back(ogg.store(docs)).collect()
    assert sorted(r.n_bytes for r in got) == [0, 0, 64, 80, 80] and all(not r.problems and not r.gaps for r in got)
    for r in got:
        text = {80: "é" * 40, 64: "a" * 64, 0: ""}[r.n_bytes].encode()
        assert bytes(r.payload) == text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")
    assert len({bytes(r.media) for r in got}) == 3
    assert ogg.read_back(ogg.store(docs.limit(0))).count() == 0
