import numpy as np
import pytest
from pyspark.sql import functions as F

from gridx.sources import fits, tables


def block(cards, fill=b" "):
    text = b"".join(c.ljust(80).encode() for c in [*cards, "END"])
    return text + fill * (-len(text) % 2880)


def card(key, value):
    return f"{key:<8}= {value!r:>20}" if not isinstance(value, str) else f"{key:<8}= '{value:<8}'"


def write(path, n, seed=1, names=("ID", "FLAG", "NAME", "FLUX", "COUNT", "BIG", "SCALED", "SMALL")):
    r = np.random.default_rng(seed)
    kind = np.dtype([("a", ">i4"), ("b", "S1"), ("c", "S6"), ("d", ">f4", (5,)), ("e", ">i2"), ("f", ">i8"), ("g", ">i2"), ("h", "u1", (2,))])
    rows = np.zeros(n, kind)
    rows["a"], rows["b"], rows["c"] = np.arange(n) + 10 * seed, np.where(np.arange(n) % 2, b"T", b"F"), [f"n{k}".encode() for k in range(n)]
    rows["d"], rows["e"], rows["f"], rows["g"], rows["h"] = r.random((n, 5)), np.arange(n) - 32768, np.arange(n) * 10**12, np.arange(n), np.arange(2 * n).reshape(n, 2) % 256
    forms = "J L 6A 5E I K I 2B".split()
    cards = ["XTENSION= 'BINTABLE'", card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", kind.itemsize), card("NAXIS2", n), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(forms))]
    for k, (name, form) in enumerate(zip(names, forms), 1):
        cards += [card(f"TTYPE{k}", name), card(f"TFORM{k}", form)]
    cards += [card("TZERO5", 32768), card("TSCAL7", 0.5), card("TZERO7", 1.25)]
    data = rows.tobytes()
    path.write_bytes(block(["SIMPLE  =                    T", card("BITPIX", 8), card("NAXIS", 1), card("NAXIS1", 5)]) + b"image".ljust(2880, b"\0") + block(cards) + data + b"\0" * (-len(data) % 2880))
    return rows


def test_rows_of_several_files(spark, tmp_path):
    made = [write(tmp_path / f"{k}.fits", n, k) for k, n in ((1, 37), (2, 5), (3, 0))]
    df = fits.table(spark, [str(tmp_path / f"{k}.fits") for k in (1, 2, 3)], split_bytes=400)
    assert df.dtypes == [("ID", "int"), ("FLAG", "boolean"), ("NAME", "string"), ("FLUX", "array<float>"), ("COUNT", "int"), ("BIG", "bigint"), ("SCALED", "double"), ("SMALL", "array<smallint>")]
    got = sorted(map(tuple, df.collect()))
    expected = sorted((int(x["a"]), x["b"] == b"T", x["c"].decode(), [float(v) for v in x["d"]], int(x["e"]) + 32768, int(x["f"]), x["g"] * 0.5 + 1.25, x["h"].tolist()) for rows in made for x in rows)
    assert got == expected and df.rdd.getNumPartitions() > 2


def test_columns_and_flattening(spark, tmp_path):
    rows = write(tmp_path / "t.fits", 9)
    df = fits.table(spark, f"file://{tmp_path}/t.fits", columns=["ID", "FLUX"])
    flat = tables.flattened(df, {"FLUX": 5})
    assert flat.columns == ["ID", "FLUX_u", "FLUX_g", "FLUX_r", "FLUX_i", "FLUX_z"]
    assert flat.agg(F.sum("FLUX_g")).first()[0] == pytest.approx(float(rows["d"][:, 1].sum()), rel=1e-6)


def test_files_that_are_no_tables(spark, tmp_path):
    write(tmp_path / "t.fits", 9)
    write(tmp_path / "u.fits", 9, names=tuple("ABCDEFGH"))
    with pytest.raises(ValueError, match="no binary table"):
        fits.table(spark, str(tmp_path / "t.fits"), extension=0)
    with pytest.raises(ValueError, match="differ"):
        fits.table(spark, [str(tmp_path / "t.fits"), str(tmp_path / "u.fits")])
    with pytest.raises(ValueError, match="END"):
        fits.table(spark, str(tmp_path / "t.fits"), extension=2)
