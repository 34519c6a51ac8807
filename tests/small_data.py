"""The smallest driver tables (a module of its own name: ``conftest`` exists in two folders)."""

SF_SMALL = "/root/testdata/sf0.001"
