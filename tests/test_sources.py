"""File formats, configuration, logs and streams."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunstack.plans import config
from sunstack.sources import ana, bits, files, fits, pointing
from sunstack.streaming import ingest

TYPES = ["u1", "i2", "i4", "f4", "f8"]


def gradient(h: int, w: int, kind: str) -> np.ndarray:
    return np.add.outer(np.arange(h), np.arange(w)).astype(kind)


@pytest.mark.parametrize("kind", TYPES)
@pytest.mark.parametrize("big", [False, True])
def test_ana_round_trip(kind, big):
    px = gradient(4, 5, kind)
    got, head = ana.decode(ana.encode(px, "a header " * 80, big=big))
    assert (got == px).all() and got.dtype == px.dtype and head["text"] == ("a header " * 80).strip()


@pytest.mark.parametrize("kind", ["u1", "i2", "i4"])
def test_ana_compressed_at_every_slice(kind):
    px = gradient(8, 50, kind)
    px[2, 7] = np.iinfo(kind).max
    px[3, 9] = np.iinfo(kind).min
    for low_bits in range(1, 8 * px.itemsize - 1, 3):
        assert (ana.decode(ana.encode(px, low_bits=low_bits))[0] == px).all()
        if px.itemsize < 4:
            px[5, 3:40] = 9
            assert (ana.decode(ana.encode(px, low_bits=low_bits, runs=True))[0] == px).all()


def test_ana_errors():
    good = ana.encode(gradient(4, 5, "i2"))
    for bad in (b"", b"x" * 600, good[:-1], good[:100]):
        with pytest.raises(ValueError):
            ana.decode(bad)


@pytest.mark.parametrize("kind", [*TYPES, "u2", "u4", "i8"])
def test_fits_round_trip(kind):
    px = gradient(4, 5, kind)
    got, cards = fits.decode(fits.encode(px, fits.make_cards("origin", "it's", "where")))
    assert (got == px).all() and fits.merged(cards)["ORIGIN"] == "it's"


@pytest.mark.parametrize("kind", ["i2", "u2"])
def test_fits_rice_tiles(kind):
    px = np.random.default_rng(0).integers(0, 3000, (6, 70)).astype(kind)
    px[2] = 7
    px[3, ::2] = np.iinfo(kind).max
    assert (fits.decode(fits.encode(px, rice=True))[0] == px).all()


def test_fits_tables():
    times = ["2020-01-01T00:00:00", "2020-01-01T00:00:01.5"]
    data = fits.encode(gradient(4, 5, "i2")) + fits.encode_table({"DATE-BEG": times, "N": ["1", ""]})
    assert fits.tables(data) == [{"DATE-BEG": times, "N": ["1", None]}]
    assert fits.decode(data)[0].shape == (4, 5)


def test_rice_blocks():
    rng = np.random.default_rng(1)
    for spread in (0, 1, 40, 60000):
        v = rng.integers(-spread // 2, spread // 2 + 1, 101).astype(np.int16)
        assert (bits.rice_decode(bits.rice_encode(v), len(v)) == v).all()


def test_fits_cards():
    for v in (True, False, 0, -12, 1.5, -2e-7, "short", "quote's", "x" * 200 + "'" * 30, ""):
        assert fits.merged(fits.make_cards("key", v, "c" if len(str(v)) < 60 else "")) == {"KEY": v}
    assert fits.split_card(fits.make_cards("k", "a/b", "note")[0]) == ("K", "'a/b     '", "note")
    for c in range(256):
        ok = chr(c).isascii() and (chr(c).isalnum() or chr(c) in "-_")
        if ok:
            assert fits.make_cards(f"A{chr(c)}", 1)
        else:
            with pytest.raises(ValueError):
                fits.make_cards(f"A{chr(c)}", 1)


def test_read_and_write_frames(spark, tmp_path):
    cube = np.stack([gradient(4, 5, "f4") + i for i in range(4)])
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.f0").write_bytes(ana.encode(gradient(4, 5, "i2"), "4 SUM= x"))
    (tmp_path / "in/c.fits").write_bytes(fits.encode(cube))
    (tmp_path / "in/bad.f0").write_bytes(b"nothing")
    path = f"file://{tmp_path}/in"
    rows = files.read_frames(spark, path, discard=(1, 1)).collect()
    assert sorted((r["file"].rsplit("/")[-1], r["frame_in_file"]) for r in rows if r["error"] is None) == [("a.f0", 0), ("c.fits", 1), ("c.fits", 2)]
    assert [r["file"].rsplit("/")[-1] for r in rows if r["error"]] == ["bad.f0"]
    heads = {r["file"].rsplit("/")[-1]: r for r in files.read_headers(spark, path).collect()}
    assert heads["c.fits"]["n_frames"] == 4 and heads["a.f0"]["dims"] == [4, 5] and heads["bad.f0"]["error"]
    kinds = spark.read.format("binaryFile").load(path).select("path", files.file_type(F.col("path"), F.col("content")).alias("t")).collect()
    assert {r["path"].rsplit("/")[-1]: r["t"] for r in kinds} == {"a.f0": "ANA", "c.fits": "FITS", "bad.f0": "ANA"}
    good = files.read_frames(spark, path).where("error IS NULL").withColumn("name", F.concat(F.lit("o"), F.col("frame_in_file"), F.lit(".fits"))).where("format = 'FITS'")
    files.write_files(files.encoded(good, "FITS", "int16", rice=True), str(tmp_path / "out"))
    assert (fits.decode((tmp_path / "out/o3.fits").read_bytes())[0] == cube[3].astype("i2")).all()
    assert files.directory_size(spark, path).first()["bytes"] > 0


CONFIG = """
momfbd {            ; a job
  NUM_POINTS 64     // points
  MODES 2-4,K5-7
  TELESCOPE_D 0.97
  object {
    WAVELENGTH 6.302e-07
    ARCSECPERPIX 0.059
    PIXELSIZE 1.6e-05
    channel { FILENAME_TEMPLATE "cam_%04d.f0"
      IMAGE_NUMS 3-5,9
      DT 1
      IMAGE_DATA_DIR /data/
    }
    channel { FILENAME_TEMPLATE x_%d
      NO_RESTORE
      BORDER_CLIP 7 }
  }
}
"""


def test_configuration():
    (job,) = config.bind(config.parse_info(CONFIG), {"MAX_ITER": "30"})
    ch = job.parts[0].parts
    assert (job["NUM_POINTS"], job["MAX_ITER"], ch[0]["NUM_POINTS"], ch[0]["BORDER_CLIP"], ch[1]["BORDER_CLIP"], ch[1]["NO_RESTORE"], ch[0]["NO_RESTORE"]) == (64, 30, 64, 100, 7, True, False)
    assert config.image_files(ch[0]) == [f"/data/cam_{n:04d}.f0" for n in (4, 5, 6, 10)]
    assert config.problems(job) == []
    assert config.mode_list(str(job["MODES"])) == [(2, "Z"), (3, "Z"), (4, "Z"), (5, "K"), (6, "K"), (7, "K")]
    assert config.diversity("1.5 mm, 0.3") == [(0.0015, True), (0.3, False)]
    assert config.image_scale(0, 0.1, 1e-5)[0] == pytest.approx(20.6265, abs=1e-3)
    bad = config.bind(config.parse_info("momfbd { NUM_POINTS 30\n FLATFIELD\n CALIBRATE\n object { } }"))[0]
    assert len(config.problems(bad)) == 4
    for text in ("momfbd {", "}", "{ }"):
        with pytest.raises(ValueError):
            config.parse_info(text)
    assert config.parse_info(config.legacy("NUM_POINTS = 88\nMODES=2-4")).blocks[0].values["NUM_POINTS"] == "88"
    assert config.next_step("PREPROCESS", True) == "COMPLETED" and config.next_step("RUNNING") == "DONE"
    assert config.dump(job)["parts"][0]["WAVELENGTH"] == pytest.approx(6.302e-7)


def test_pointing_log(spark):
    lines = ["# comment", "10 0 0 100 200 950", "20 0 0 110 210 950", "broken line", "30 0 0 120 190 950", ""]
    log = pointing.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert log.count() == 3
    out = pointing.convert(log, "2020-06-01", average=2).collect()
    assert len(out) == 1 and out[0]["x"] == 105 and str(out[0]["time"]).startswith("2020-06-01 00:00:15")
    assert abs(out[0]["b0"] + 0.7) < 0.5 and abs(out[0]["p"] + 15) < 1.5


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:{s:02d}", c, [1.0 + c, float(m), float(s)]) for m in range(6) for s in (0, 20, 40) for c in (0, 1)]
    df = spark.createDataFrame(rows, "t string, channel int, px array<double>").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest.run_once(ingest.windowed_stack(stream, "t", "2 minutes", "1 minute"), "stacked", "complete")
    batch = ingest.windowed_stack(df, "t", "2 minutes", "1 minute")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("stacked")) == key(batch) and batch.count() == 18
    ingest.run_once(ingest.windowed_stack(stream, "t", "2 minutes", "1 minute", limit=12.0), "limited", "complete")
    assert sum(r["n_frames"] for r in spark.table("limited").collect()) < sum(r["n_frames"] for r in batch.collect())


def test_headers_tell_what_pixels_would():
    rng = np.random.default_rng(1)
    for px in (rng.integers(0, 9, (3, 4, 5)).astype(np.int16), rng.random((6, 7)).astype(np.float32), rng.integers(0, 200, (5, 6)).astype(np.uint8)):
        made = [ana.encode(px, "text"), fits.encode(px)]
        if px.dtype.kind in "iu" and px.ndim == 2 or px.dtype == np.int16:
            made.append(ana.encode(px, low_bits=3))
        if px.dtype == np.int16:
            made.append(fits.encode(px[0], rice=True))
        for data in made:
            pixels, kind, text, cards = files.decode(data)
            assert files.describe(data) == (kind, list(pixels.shape), str(pixels.dtype), text, cards)
