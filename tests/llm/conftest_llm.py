"""Helpers of these tests."""

SMALL = "/root/testdata/sf0.001"


def pairs_of(groups):
    """Distinct pairs that share a group."""
    return {(i, j) for g in groups for i in g for j in g if i < j}
