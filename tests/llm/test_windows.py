import numpy as np

from poolscout.llm import textkernel as tk
from poolscout.llm import windows as ws
from poolscout.llm.common import unpack


def key_of(mixed: int) -> int:
    """The key whose mix with seed 53 is given."""
    m = 2**64 - 1

    def unshift(x, by):
        out = x
        for _ in range(64 // by + 1):
            out = x ^ (out >> by)
        return out

    x = unshift(mixed, 31) * pow(0x94D049BB133111EB, -1, 2**64) & m
    x = unshift(x, 27) * pow(0xBF58476D1CE4E5B9, -1, 2**64) & m
    return (unshift(x, 30) - (53 * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019)) & m


def test_keys_that_agree_in_what_travels_alone_are_not_shared():
    keys = np.array([key_of((7 << 32) | k) for k in range(4000)], dtype=np.uint64)
    assert set(ws.short(keys).tolist()) == {7} and len(set(keys.tolist())) == 4000
    docs = np.arange(4000)
    hit, _ = ws.hits(keys, None, docs, later=False)
    assert not hit.any()
    out = ws.send(keys, None, docs, 1000, later=False, wire=ws.short).to_pydict()
    assert not any(out["passed"]) and len(out["bucket"]) > 900
    assert max(len(a) for a in out["a"]) <= 4 * 20  # dealt by the whole key, four bytes of it on the way


def test_equal_keys_meet_in_one_bucket_and_settle_in_their_slice():
    keys, docs = np.array([5, 6, 5, 5], dtype=np.uint64), np.array([1, 1, 2, 3])
    out = ws.send(keys, None, docs, 64, later=True, wire=ws.short)
    passed = out.filter(out.column("passed"))
    assert sorted(unpack(passed.column("d")).tolist()) == [2, 3]
    again = ws.send(keys[:1], None, np.array([9]), 64, later=True, wire=ws.short).to_pydict()
    asked = out.filter(np.logical_not(out.column("passed").to_numpy(zero_copy_only=False))).to_pydict()
    assert again["bucket"][0] in asked["bucket"] and again["a"][0] == ws.short(keys[:1]).tobytes()
    assert tk.mix(keys, 52)[0] == tk.mix(keys, 52)[2]
