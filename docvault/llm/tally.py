"""Counts of strings inside a task, summed up before they leave it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

HELD = 1 << 19              # distinct keys kept in a task before they are sent on


class Tally:
    """Sums ``n`` by the other columns; ``full`` gives what has to go, ``rest`` the remainder at the end."""

    def __init__(self, schema: pa.Schema, held: int = HELD):
        self.schema, self.most = schema, held
        self.keys = [name for name in schema.names if name != "n"]
        # Long strings inside, so that many texts end to end have no limit of length.
        self.inner = pa.schema([(f.name, pa.large_string() if pa.types.is_string(f.type) else f.type) for f in schema])
        self.tables, self.size = [], 0

    def _sum(self) -> pa.Table:
        found = pa.concat_tables(self.tables).group_by(self.keys).aggregate([("n", "sum")])
        return pa.table({name: found["n_sum" if name == "n" else name] for name in self.schema.names}).cast(self.inner)

    def add(self, table: pa.Table) -> None:
        self.tables.append(table.select(self.schema.names).cast(self.inner))
        self.size += len(table)

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.size > 2 * self.most:
            self.tables = [self._sum()]
            self.size = len(self.tables[0])
            if self.size > self.most:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            found = self._sum()
            for low in range(0, len(found), 1 << 15):
                yield from found.slice(low, 1 << 15).cast(self.schema).combine_chunks().to_batches()
        self.tables, self.size = [], 0
