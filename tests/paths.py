"""Paths of the given tables, for the test modules."""

SF_SMALL = "/root/testdata/sf0.001"
