"""Column expressions over file names and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions taken as images; as raw camera data that queries leave out; and those that are never raw.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "ppm", "pgm", "pbm", "pnm", "bmp", "exif", "tiff", "tif", "gif", "nef", "dng", "cr2", "raf", "arw")
RAW_EXTENSIONS = ("3fr", "ari", "arw", "bay", "crw", "cr2", "cr3", "cap", "data", "dcs", "dcr", "dng", "drf", "eip", "erf", "fff", "gpr", "iiq", "k25", "kdc", "mdc", "mef", "mos", "mrw", "nef", "nrw", "obm", "orf", "pef", "ptx", "pxn", "r3d", "raf", "raw", "rwl", "rw2", "rwz", "sr2", "srf", "srw", "tif", "x3f")
NEVER_RAW = ("jpg", "png", "bmp", "gif")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_stem(path: Column) -> Column:
    """The name up to its first dot: the rule that lists of sources are deduplicated by."""
    return F.split(basename(path), r"\.")[0]


def last_stem(path: Column) -> Column:
    """The name without its last extension: the rule of results."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def is_raw(path: Column) -> Column:
    return extension(path).isin(*RAW_EXTENSIONS) & ~extension(path).isin(*NEVER_RAW)


def mimetype(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin("jpg", "jpeg", "jpe"), "image/jpeg").when(e.isin("tif", "tiff"), "image/tiff").when(e.isin("png", "gif", "bmp", "webp"), F.concat(F.lit("image/"), e)).when(e == "json", "application/json").when(e.isin("txt", "csv"), "text/plain").otherwise("application/octet-stream")


def hash_floats(text: Column) -> Column:
    """The characters of a hash string as code / 1000."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) * F.lit(0.001))


def index_spec(spec: Column) -> Column:
    """Parts of an index description such as ``OPQ8_32,IVF256,PQ8``: preprocessing, number of cells, coding."""
    return F.struct(
        F.regexp_extract(spec, r"^((?:OPQ\d+(?:_\d+)?|PCAR\d+),)?IVF", 1).alias("preproc"),
        F.regexp_extract(spec, r"IVF(\d+)", 1).cast("int").alias("cells"),
        F.regexp_extract(spec, r",(PQ\d+|Flat)$", 1).alias("coding"),
    )


def cluster_file(number: Column, size: Column, algorithm: str) -> Column:
    """The file name of a cluster's document."""
    return F.format_string(f"cluster%03d_size%d_algorithm_{algorithm}.json", number, size)


def percent_encoded(text: Column) -> Column:
    """Text for a URL; a blank becomes %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def bits(value: Column, n: int) -> Column:
    """The n lowest bits of a whole number as an array of 0 and 1, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(value, i).cast("int"))


def rows_in_memory(gigabytes: Column, columns: Column, bytes_each: Column) -> Column:
    return F.floor(gigabytes * F.lit(float(2**30)) / (columns * bytes_each)).cast("bigint")
