"""S2 read_gpkg_files: a folder of GeoPackages, one task per file.

``spark.read.format("binaryFile")`` lists and reads the files (splits by file); each file's
bytes are opened in-memory with the standard-library SQLite module inside ``mapInPandas``
(``Connection.deserialize``), every feature table listed in ``gpkg_contents`` is read, and the
GeoPackage geometry header is stripped so the geometry leaves as plain WKB.
"""

from __future__ import annotations

import sqlite3
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

GPKG_SCHEMA = "path string, layer string, fid long, properties map<string,string>, geometry binary"

# Envelope sizes (bytes) by the envelope indicator of the GeoPackage header flags.
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def gpkg_to_wkb(blob: bytes | None) -> bytes | None:
    """Strip the 'GP' header (magic, version, flags, srs id, envelope) and return the WKB."""
    if blob is None:
        return None
    b = bytes(blob)
    if len(b) < 8 or b[:2] != b"GP":
        return b  # already WKB
    flags = b[3]
    env = ENVELOPE_BYTES.get((flags >> 1) & 0x07, 0)
    return b[8 + env:]


def wkb_to_gpkg(wkb: bytes, srs_id: int = 4326) -> bytes:
    """Minimal GeoPackage geometry blob (no envelope, little-endian header)."""
    return b"GP" + bytes([0, 0x01]) + struct.pack("<i", srs_id) + wkb


def point_wkb(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, float(x), float(y))


def _read_one(path: str, content: bytes) -> pd.DataFrame:
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(bytes(content))
        layers = con.execute(
            "SELECT c.table_name, g.column_name FROM gpkg_contents c "
            "JOIN gpkg_geometry_columns g ON g.table_name = c.table_name WHERE c.data_type = 'features'").fetchall()
        out = []
        for layer, geom_col in layers:
            cur = con.execute(f'SELECT * FROM "{layer}"')
            names = [d[0] for d in cur.description]
            for fid_pos, row in enumerate(cur.fetchall()):
                rec = dict(zip(names, row))
                geom = gpkg_to_wkb(rec.pop(geom_col, None))
                fid = rec.pop("fid", fid_pos)
                props = {k: None if v is None else str(v) for k, v in rec.items()}
                out.append((path, layer, int(fid), props, geom))
        return pd.DataFrame(out, columns=["path", "layer", "fid", "properties", "geometry"])
    finally:
        con.close()


def parse_gpkg(files: DataFrame) -> DataFrame:
    """(path, content) rows → one row per feature; every file is parsed inside its own task."""
    def parse(batches):
        for pdf in batches:
            parts = [_read_one(p, c) for p, c in zip(pdf["path"], pdf["content"])]
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return files.select("path", "content").mapInPandas(parse, schema=GPKG_SCHEMA)


def read_gpkg_files(spark: SparkSession, folder: str, glob: str = "*.gpkg") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return parse_gpkg(files)


def build_gpkg(rows: pd.DataFrame, layer: str = "entities", x: str = "x", y: str = "y") -> bytes:
    """A small GeoPackage (bytes) with one point layer; used to write test folders and by the
    registered round-trip query (bytes built per partition)."""
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT)")
        con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        cols = [c for c in rows.columns if c not in (x, y)]
        col_sql = ", ".join(f'"{c}" TEXT' for c in cols)
        con.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB{", " + col_sql if cols else ""})')
        con.execute("INSERT INTO gpkg_contents VALUES (?, 'features')", (layer,))
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", (layer,))
        for i, r in enumerate(rows.itertuples(index=False)):
            rec = r._asdict()
            geom = wkb_to_gpkg(point_wkb(rec[x], rec[y]))
            vals = [None if rec[c] is None else str(rec[c]) for c in cols]
            ph = ", ".join("?" for _ in range(len(cols) + 2))
            con.execute(f'INSERT INTO "{layer}" VALUES ({ph})', [i + 1, geom, *vals])
        con.commit()
        return con.serialize()
    finally:
        con.close()
