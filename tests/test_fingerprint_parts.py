"""Fingerprints hold the tokens of one part of a batch."""

from newsflow.functions.fingerprints import _parts


def test_parts_are_read_one_by_one():
    read = []
    lists = (read.append(k) or (["a"] * 3 if k % 4 else []) for k in range(100))
    parts = _parts(lists, most=9)
    assert next(parts) == ([1, 2, 3], [["a"] * 3] * 3) and len(read) == 4
    assert sum(len(numbers) for numbers, _ in parts) == 72
