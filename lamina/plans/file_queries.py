"""Round trips through files and extension points; the files lie in the shared folder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lamina.catalog import register
from lamina.functions import kernels as K
from lamina.functions import plugins
from lamina.functions import topology as T
from lamina.operators import blocks as B
from lamina.operators import volume as V
from lamina.plans.views import collab, surface, table, vol, with_views
from lamina.sources import codecs, containers, images, scratch, sinks, zarr

#: Voxels of a plane, and of a chunk.
_PLANE, _CHUNK = (16, 16), (4, 8, 8)
_VOXELS = with_views("select z, y, x, cast(v as double) as v from vol", "vol")


#: Stands for a voxel without a row in files of 16-bit values.
_ABSENT = 2**16 - 1


def _u8(s, d):
    """Chunk rows of the volume as bytes."""
    return _chunked(vol(s, d))


def _chunked(v, dtype="u1", fill=0):

    def run(pdf):
        a = np.full(_CHUNK, fill, dtype)
        a[pdf.z % 4, pdf.y % 8, pdf.x % 8] = pdf.v
        return pd.DataFrame([(pdf.z.iloc[0] // 4, pdf.y.iloc[0] // 8, pdf.x.iloc[0] // 8, a.tobytes())], columns=["cz", "cy", "cx", "data"])

    keyed = v.withColumns({f"c{c}": F.floor(F.col(c) / n) for c, n in zip("zyx", _CHUNK, strict=True)})
    return keyed.groupBy("cz", "cy", "cx").applyInPandas(run, "cz long, cy long, cx long, data binary")


def _written(v, path, level, **how):
    """A level of 16-bit chunks in which absent voxels hold the fill value."""
    meta = zarr.create(path, level, B.shape_of(v), _CHUNK, "uint16", fill=_ABSENT, **how)
    zarr.write(_chunked(v, "<u2", _ABSENT), path, meta)
    return meta


def _stored(s, d, **how):
    path = scratch.fresh(s, "zarr")
    meta = zarr.create(path, 0, B.shape_of(vol(s, d)), _CHUNK, "uint8", **how)
    zarr.write(_u8(s, d), path, meta)
    zarr.finalize(path, 1)
    s.dataSource.register(zarr.ZarrChunks)
    return path, meta


def _zarr(name, sql=_VOXELS, **how):
    def run(s, d):
        path = scratch.fresh(s, "zarr")
        meta = _written(vol(s, d), path, 0, **how)
        zarr.finalize(path, 1)
        s.dataSource.register(zarr.ZarrChunks)
        return zarr.voxels(s.read.format("zarr_chunks").load(path), meta, gaps=True)

    register(name, sql)(run)


_zarr("src_zarr_v2", codec="zstd", version=2)
_zarr("src_zarr_v3", codec="gzip", version=3)
_zarr("src_shard", codec="zstd", version=3, shard=(8, 16, 16))
_zarr("snk_chunk", codec=None, version=2)


@register("src_meta", with_views("select 0 as level, cast(max(z) + 1 as int) as nz, 16 as ny, 16 as nx, 4 as cz, 8 as cy, 8 as cx, 'zstd' as codec from vol", "vol"))
def _meta(s, d):
    path, _ = _stored(s, d, codec="zstd", version=2)
    rows = [(m["level"], *m["shape"], *m["chunks"], m["codec"]) for m in zarr.metadata(path)]
    return s.createDataFrame(rows, "level int, nz int, ny int, nx int, cz int, cy int, cx int, codec string")


@register("src_chunk", with_views("select distinct z // 4 as cz, y // 8 as cy, x // 8 as cx, 256 as n from vol where z // 4 = 1", "vol"))
def _chunk(s, d):
    path, _ = _stored(s, d, codec="zstd", version=2)
    return s.read.format("zarr_chunks").option("level", 0).load(path).where("cz = 1").select("cz", "cy", "cx", F.octet_length("data").alias("n"))


def _planes(s, d, tag, encode):
    """One file of 16-bit values per plane, written by the executors; returns the folder."""
    path = scratch.fresh(s, tag)
    sinks.write_planes(vol(s, d), path, tag, encode, _PLANE, "<u2", _ABSENT)
    return path


def _pixels(df, column="data"):
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a = np.frombuffer(getattr(r, column), r.dtype).reshape(16, 16)
                y, x = np.nonzero(a != _ABSENT)
                yield pd.DataFrame({"z": int(r.path.rsplit("/", 1)[1].split(".")[0]), "y": y, "x": x, "v": a[y, x].astype(float)})

    return df.select("path", "dtype", column).mapInPandas(run, "z long, y long, x long, v double")


def _npy(a):
    import io

    f = io.BytesIO()
    np.save(f, a)
    return f.getvalue()


_NRRD_HEAD = b"NRRD0004\ntype: ushort\ndimension: 2\nsizes: 16 16\nendian: little\nencoding: raw\n\n"
register("src_tiff", _VOXELS)(lambda s, d: _pixels(images.read_tiff(s, _planes(s, d, "tif", lambda a: images.tiff_bytes([a])))))
register("src_ppm", _VOXELS)(lambda s, d: _pixels(images.read_ppm(s, _planes(s, d, "pgm", images.ppm_bytes))))
register("src_nrrd", _VOXELS)(lambda s, d: _pixels(images.read_nrrd(s, _planes(s, d, "nrrd", lambda a: _NRRD_HEAD + a.tobytes()))))
register("src_npy", _VOXELS)(lambda s, d: _pixels(images.read_npy(s, _planes(s, d, "npy", _npy))))


_CORNER = with_views("select row, col, x, y, round(z, 3) as z from surf", "surf")


def _corner(s, d):
    return surface(s, d).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "x", "y", F.round("z", 3).alias("z"))


_BAND = 8


def _bands(s, d, kind):
    """Bands of eight rows as files; returns the folder."""
    path = scratch.fresh(s, "surface")
    sinks.write_surfaces(_corner(s, d), path, F.floor(F.col("row") / _BAND), kind)
    return path


def _placed(df):
    """Rows of all bands in one grid."""
    band = F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("int")
    return df.where("x is not null and not isnan(x)").select((F.col("row") + band * _BAND).alias("row"), "col", "x", "y", F.round("z", 3).alias("z"))


register("src_surface_json", _CORNER)(lambda s, d: _placed(images.read_surface_json(s, _bands(s, d, "json"), named=True)))
register("src_tifxyz", _CORNER)(lambda s, d: _placed(images.read_tifxyz(s, _bands(s, d, "tif"))))


@register("snk_tiff", with_views("select z // 4 as stack, z % 4 as page, cast(sum(v * (y * 16 + x + 1)) as bigint) as checksum from vol group by 1, 2", "vol"))
def _stacks(s, d):
    """Stacks of four pages, read back page by page."""
    path = scratch.fresh(s, "stacks")
    sinks.write_stacks(vol(s, d), path, 4, _PLANE)
    return _checked(images.read_tiff(s, path).select("path", F.col("page").alias("n"), "data"), "stack", "page")


@register("snk_video", with_views("select z // 4 as clip, z % 4 as frame, cast(sum(v * (y * 16 + x + 1)) as bigint) as checksum from vol group by 1, 2", "vol"))
def _clips(s, d):
    """Clips of four frames, read back frame by frame."""
    path = scratch.fresh(s, "clips")
    sinks.write_clips(vol(s, d), path, 4, _PLANE)
    return _checked(sinks.read_clips(s, path).select("path", F.col("frame").alias("n"), "data"), "clip", "frame")


def _checked(pages, file, page):
    """Weighted sums of pages (path, n, data of 16 x 16 bytes)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({file: [int(p.rsplit("/", 1)[1].split(".")[0]) for p in pdf.path], page: pdf.n, "checksum": [int(np.frombuffer(x, "u1") @ np.arange(1, 257)) for x in pdf.data]})

    return pages.mapInPandas(run, f"{file} long, {page} long, checksum long")


@register("snk_finalize", with_views("with m as (select max(z) + 1 as nz from vol) select cast(l as int) as level, pow(2e0, l) as scale, cast((nz + (1 << l) - 1) >> l as int) as nz, cast(16 >> l as int) as nyx from m, range(3) t(l)", "vol"))
def _pyramid_file(s, d):
    """Three levels written as a pyramid; scales from its metadata, shapes from its levels."""
    path, v = scratch.fresh(s, "pyramid"), vol(s, d)
    shape = B.shape_of(v)
    for level in range(3):
        size = tuple(-(-n // 2**level) for n in shape)
        meta = zarr.create(path, level, size, _CHUNK, "uint8", codec="zstd", version=3)
        zarr.write(_chunked(v), path, meta)
        v = V.scale(v, 2).withColumn("v", F.floor("v"))
    zarr.finalize(path, 3)
    scale = zarr.scales(path)
    return s.createDataFrame([(m["level"], scale[m["level"]][0], *m["shape"][:2]) for m in zarr.metadata(path)], "level int, scale double, nz int, nyx int")


@register("src_open", with_views("with h as (select z // 2 as z, y // 2 as y, x // 2 as x, floor(sum(v) / 8e0) as v from vol group by 1, 2, 3) select z, y, x, cast(v as double) as v from h", "vol"))
def _open(s, d):
    """A pyramid opened by its path; the voxels of its second level."""
    path, v = scratch.fresh(s, "pyramid"), vol(s, d)
    for level in range(2):
        _written(v, path, level, codec="zstd", version=2 + level)
        v = V.scale(v, 2).withColumn("v", F.floor("v"))
    s.dataSource.register(zarr.ZarrChunks)
    return zarr.voxels(s.read.format("zarr_chunks").load(path), zarr.metadata(path)[1], gaps=True)


@register("ag_betti")
def _betti(s, d):
    """Parts and holes of the bright voxels of every plane; tests hold them against flood fills."""

    def run(pdf):
        m = sinks.dense(pdf, "yx", _PLANE) >= 150
        return pd.DataFrame([(int(pdf.z.iloc[0]), *T.betti2d(m))], columns=["z", "parts", "holes"])

    return vol(s, d).groupBy("z").applyInPandas(run, "z long, parts long, holes long")


@register("snk_mask_bin", with_views("select z // 4 as part, count(*) filter (v >= 128) as set_voxels from vol group by 1", "vol"))
def _mask_file(s, d):
    """Masks of four planes, a file each."""
    path = scratch.fresh(s, "mask")
    part = F.format_string("%d.bin", F.floor(F.col("z") / 4))
    sinks.write_groups(vol(s, d), path, part, lambda pdf: containers.mask_bytes(sinks.dense(pdf, "zyx", (int(pdf.z.max() - pdf.z.min()) + 1, *_PLANE)) >= 128))
    count = F.udf(lambda b: int(containers.parse_mask(bytes(b)).sum()), "long")
    return s.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long").alias("part"), count("content").alias("set_voxels"))


@register("op_c4d_file", with_views("select z // 4 as cz, y // 8 as cy, x // 8 as cx, true as close from vol group by 1, 2, 3", "vol"))
def _container(s, d):
    """Slabs of chunks in containers and back, within half a step."""
    path, shape = scratch.fresh(s, "container"), B.shape_of(vol(s, d))

    def encode(pdf):
        chunks = [(r.cz, r.cy, r.cx, np.frombuffer(r.data, "u1").astype(float) - 128) for r in pdf.itertuples()]
        return containers.container_bytes([{"shape": shape, "chunk": _CHUNK, "chunks": chunks}], 1.5)

    raw = _u8(s, d)
    sinks.write_groups(raw, path, F.format_string("%d.bin", "cz"), encode)
    near = F.udf(lambda a, b: bool(np.abs(np.frombuffer(a) - (np.frombuffer(b, "u1").astype(float) - 128)).max() <= 0.75 + 1e-9), "boolean")
    back = containers.read_container(s, path).select("cz", "cy", "cx", F.col("data").alias("got"))
    return back.join(raw, ["cz", "cy", "cx"]).select("cz", "cy", "cx", near("got", "data").alias("close"))


def _slabs(s, d, run, schema):
    """``run(array of two planes, number of the slab)`` for every pair of planes; an odd last plane meets an empty one."""

    def each(pdf):
        n = int(pdf.slab.iloc[0])
        a = np.zeros((2, *_PLANE))
        a[pdf.z - 2 * n, pdf.y, pdf.x] = pdf.v
        return run(a, n)

    return vol(s, d).withColumn("slab", F.floor(F.col("z") / 2)).groupBy("slab").applyInPandas(each, schema)


@register("cdc_pyramid_enc", with_views("select z // 2 as slab, true as close, true as smaller from vol group by 1", "vol"))
def _pyramid_codec(s, d):
    """Two levels of every slab through the residual pyramid codec, within half a step."""

    def run(a, n):
        half = a.reshape(1, 2, 8, 2, 8, 2).mean((1, 3, 5))
        codes = codecs.pyramid_encode([a, half], 4.0)
        got = codecs.pyramid_decode(codes, [half.shape, a.shape])
        return pd.DataFrame({"slab": [n], "close": [bool(np.abs(got[1] - a).max() <= 2 + 1e-9)], "smaller": [sum(map(len, codes)) < 8 * (a.size + half.size)]})

    return _slabs(s, d, run, "slab long, close boolean, smaller boolean")


@register("cdc_pyramid_dec", with_views("with h as (select z // 2 as z, y // 2 as y, x // 2 as x, sum(v) / 8e0 as v from vol group by 1, 2, 3), r as (select max(v) as top from h) select z, y, x, true as near from h", "vol"))
def _pyramid_decode(s, d):
    """The coarse level alone decoded from a pyramid's first code, voxel by voxel within half a step of the means."""

    def run(a, n):
        half = a.reshape(1, 2, 8, 2, 8, 2).mean((1, 3, 5)) - 128
        got = codecs.pyramid_decode(codecs.pyramid_encode([a - 128, half], 2.0)[:1], [half.shape])[0]
        y, x = np.indices(half.shape[1:])
        return pd.DataFrame({"z": n, "y": y.ravel(), "x": x.ravel(), "near": (np.abs(got - half) <= 1 + 1e-9).ravel()})

    return _slabs(s, d, run, "z long, y long, x long, near boolean")


@register("cdc_blosc", with_views("select z // 4 as cz, y // 8 as cy, x // 8 as cx, cast(sum(v) as bigint) as total, true as same from vol group by 1, 2, 3", "vol"))
def _blosc(s, d):
    """Chunks as containers of shuffled blocks, decoded again."""

    def run(batches):
        for pdf in batches:
            back = [codecs.blosc_decode(codecs.blosc_encode(np.frombuffer(x, "u1").astype("<u2").tobytes(), 2)) for x in pdf.data]
            yield pd.DataFrame({"cz": pdf.cz, "cy": pdf.cy, "cx": pdf.cx, "total": [int(np.frombuffer(b, "<u2").sum()) for b in back], "same": [b == np.frombuffer(x, "u1").astype("<u2").tobytes() for b, x in zip(back, pdf.data, strict=True)]})

    return _u8(s, d).mapInPandas(run, "cz long, cy long, cx long, total long, same boolean")


@register("cdc_zarr_c4d", with_views("select z // 4 as cz, y // 8 as cy, x // 8 as cx, 256 as n, true as close from vol group by 1, 2, 3", "vol"))
def _float_codec(s, d):
    """Float chunks through the residual chunk codec, whose scale follows the chunk's range."""

    def run(batches):
        for pdf in batches:
            raw = [np.frombuffer(x, "u1").astype("<f4") / 255 for x in pdf.data]
            back = [codecs.chunk_decode(codecs.chunk_encode(a)) for a in raw]
            yield pd.DataFrame({"cz": pdf.cz, "cy": pdf.cy, "cx": pdf.cx, "n": [len(b) for b in back], "close": [bool(np.abs(b - a).max() <= a.max() / 252 + 1e-6) for a, b in zip(raw, back, strict=True)]})

    return _u8(s, d).mapInPandas(run, "cz long, cy long, cx long, n int, close boolean")


@register("src_mirror", with_views("select z // 4 as cz, y // 8 as cy, x // 8 as cx from vol group by 1, 2, 3", "vol"))
def _mirror(s, d):
    path = scratch.fresh(s, "mirror")
    remote = _u8(s, d).withColumn("level", F.lit(0))
    containers.mirror(remote.where("cz = 0"), path)
    return containers.mirror(remote, path).select("cz", "cy", "cx")


@register("ud_handler", with_views("select event_id, case edit_type when 0 then 'seg ' || user_id when 1 then 'note ' || user_id else 'unknown' end as reply from collab", "collab"))
def _ud_handler(s, d):
    user = F.col("user_id").cast("string")
    handlers = {0: F.concat(F.lit("seg "), user), 1: F.concat(F.lit("note "), user)}
    return collab(s, d).select("event_id", plugins.dispatch(F.col("edit_type"), handlers, F.lit("unknown")).alias("reply"))


@register("ud_plugin", with_views("select z, y, x, 255 - v as v from vol", "vol"))
def _ud_plugin(s, d):
    plugins.plugin("invert")(lambda df: df.withColumn("v", 255 - F.col("v")))
    return plugins.run("invert", vol(s, d))


@register("ud_pc_iter", with_views("select row, col, round(x * x + y * y, 6) as r2 from surf", "surf"))
def _ud_points(s, d):
    return plugins.for_each_point(surface(s, d), lambda p: pd.DataFrame({"row": p.row, "col": p.col, "r2": (p.x**2 + p.y**2).round(6)}), "row long, col long, r2 double")


@register("ud_row_cb", "select 5 as seen")
def _ud_rows(s, d):
    rows = []
    seen = plugins.each_row(table(s, d, "supplier").select("s_suppkey").orderBy("s_suppkey"), lambda r: rows.append(r) or len(rows) < 5)
    return s.createDataFrame([(seen,)], "seen int")


@register("ip_normals")
def _normals(s, d):
    """Largest component of the direction of least change, by chunks with halos; tests hold eigenvectors on a ramp."""

    def kernel(a, origin):
        _, vectors = np.linalg.eigh(K.symmetric(K.structure_tensor(a, 0.3, 0.0)))
        return np.abs(vectors[..., 0]).max(-1)

    v = vol(s, d)
    return B.to_voxels(B.with_halo(B.to_chunks(v, (7, 8, 8)), (7, 8, 8), 7, kernel, B.shape_of(v)), (7, 8, 8)).withColumn("v", F.round("v", 6))


@register("ag_render", with_views("with m as (select y, x, max(v) as m from vol group by 1, 2), r as (select min(m) as lo, max(m) as hi from m) select y, x, cast(floor(greatest(0e0, least(1e0, (m - lo) / cast(hi - lo as double))) * 255e0 + 5e-1) as int) as level from m, r", "vol"))
def _render(s, d):
    from lamina.functions.colours import index

    m = V.composite(vol(s, d), "max")
    ends = m.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    # equal columns are all at the top of the map
    at = F.when(F.col("hi") > F.col("lo"), F.try_divide(F.col("c") - F.col("lo"), F.col("hi") - F.col("lo"))).otherwise(1.0)
    return m.join(F.broadcast(ends)).select("y", "x", index(at).alias("level"))


@register("sm_events", with_views("select event_id, coalesce(nullif(ts_ms % 7, 0), 99) as stamp from collab", "collab"))
def _events(s, d):
    """A stamp of zero is replaced on append."""
    return collab(s, d).select("event_id", F.coalesce(F.nullif(F.col("ts_ms") % 7, F.lit(0)), F.lit(99)).alias("stamp"))


@register("flt_mask_get", with_views("select z, y, x, v >= 128 or (z = 2 and y = 3 and x = 4) as m from vol where z = 2 and y = 3", "vol"))
def _mask_get(s, d):
    base = vol(s, d).select("z", "y", "x", (F.col("v") >= 128).alias("m"), F.lit(0).alias("seq"))
    edit = s.createDataFrame([(2, 3, 4, True, 1)], "z long, y long, x long, m boolean, seq int")
    log = base.unionByName(edit).where("z = 2 and y = 3")
    return log.groupBy("z", "y", "x").agg(F.max_by("m", "seq").alias("m"))


@register("src_volpkg", "select url as path, case when url like '%/en/%' then 'volumes' else 'paths' end as kind from pages")
def _volpkg(s, d):
    u = F.col("url")
    return table(s, d, "pages").select(u.alias("path"), F.when(u.contains("/en/"), "volumes").otherwise("paths").alias("kind"))
