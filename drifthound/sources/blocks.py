"""Tables in blocks of a fixed number of rows, in the shared folder, for tasks that read one block after the other."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .files import place_of
from .runs import shared_folder


def write_blocks(df: DataFrame, rows: int, name: str = "blocks") -> list[str]:
    """The addresses of the table's blocks, of at most `rows` rows each; a task that runs twice leaves a file that none asks for."""
    folder = shared_folder(df.sparkSession, name)
    system, path = place_of(folder)
    system.create_dir(path, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            address = f"{folder}/{uuid.uuid4().hex}"
            system, path = place_of(address)
            with system.open_output_stream(path) as sink, pa.ipc.new_stream(sink, held[0].schema) as out:
                for b in held:
                    out.write_batch(b)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([address])], names=["address"])

        room = rows
        for b in batches:
            while b.num_rows:
                part, b = b.slice(0, room), b.slice(min(room, b.num_rows))
                held.append(part)
                room -= part.num_rows
                if not room:
                    yield close()
                    room = rows
        if held:
            yield close()

    return sorted(r.address for r in df.mapInArrow(put, "address string").collect())


def read_block(address: str) -> pa.Table:
    system, path = place_of(address)
    with system.open_input_stream(path) as source:
        return pa.ipc.open_stream(source).read_all()
