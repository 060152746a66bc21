import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparklog.functions import codec
from sparklog.functions.hashes import crc32c, murmur2

#: Known answers of the client hash.
VECTORS = {
    b"21": -973932308, b"foobar": -790332482, b"a-little-bit-long-string": -985981536, b"a-little-bit-longer-string": -1486304829,
    b"lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8": -58897971, b"abc": 479470107,
}


def test_murmur2_vectors():
    assert murmur2(list(VECTORS)).tolist() == list(VECTORS.values())
    assert (int(murmur2([b"foobar"])[0]) & 0x7FFFFFFF) % 50 == 16


def test_crc32c_check_value():
    assert crc32c(b"123456789") == 0xE3069283


@given(st.integers(0, 3_000), st.integers(0, 255))
def test_crc32c_of_long_data(n, seed):
    """The check is linear: any way of cutting the bytes into lanes gives what one byte after another gives."""
    data = bytes((i * 31 + seed) % 251 for i in range(n))
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    assert crc32c(data) == crc ^ 0xFFFFFFFF


@given(st.integers(-(2**63), 2**63 - 1))
def test_varints(n):
    data = codec.put_varint(n)
    assert codec.get_varint(data + b"x", 0) == (n, len(data))


records = st.builds(
    codec.Record, st.integers(0, 2**31 - 1), st.integers(-(2**40), 2**40), st.none() | st.binary(max_size=20), st.none() | st.binary(max_size=40),
    st.lists(st.tuples(st.text(max_size=5), st.none() | st.binary(max_size=5)), max_size=3),
)


@settings(max_examples=60, deadline=None)
@given(st.lists(records, max_size=5), st.integers(0, 2**40))
def test_batch_round_trip(rs, base):
    head, back = codec.decode_batch(codec.encode_batch(base, rs, base_timestamp=5, producer_id=3, producer_epoch=1, base_sequence=0))
    assert back == rs and head["base_offset"] == base and head["magic"] == 2 and head["records_count"] == len(rs)


def test_wal_round_trip_and_errors():
    batch = codec.encode_batch(7, [codec.Record(0, value=b"v")])
    data = codec.wal_head(1, 2, 2) + codec.wal_entry("a", 0, batch) + codec.wal_entry("b", 3, batch)
    found = list(codec.wal_entries(data))
    assert [(t, p) for t, p, *_ in found] == [("a", 0), ("b", 3)] and all(data[a:b] == batch for *_, a, b in found)
    with pytest.raises(ValueError):
        list(codec.wal_entries(b"WAL2" + data[4:]))
    with pytest.raises(ValueError):
        codec.decode_record(codec.put_varint(-5), 0)
    with pytest.raises(ValueError):
        codec.decode_batch(batch[:40])
