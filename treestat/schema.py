"""Fixed schemas of the catalogue tables."""

from pyspark.sql import types as T

ENTRIES = T.StructType([
    T.StructField("parent_path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("entry_type", T.IntegerType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("atime", T.LongType()),
    T.StructField("ctime", T.LongType()),
    T.StructField("mode", T.LongType()),
    T.StructField("uid", T.LongType()),
    T.StructField("gid", T.LongType()),
    T.StructField("nlink", T.LongType()),
    T.StructField("inode", T.LongType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("blocks", T.LongType()),
    T.StructField("extension", T.StringType()),
])

#: One row of a directory listing before normalisation; stat fields are NULL together when there were no attributes.
RAW_LISTING = T.StructType([
    T.StructField("parent_path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("inode", T.LongType()),
    T.StructField("parent_depth", T.IntegerType()),
    T.StructField("scan_seq", T.LongType()),
    T.StructField("type_code", T.IntegerType()),
    T.StructField("size", T.LongType()),
    T.StructField("used", T.LongType()),
    T.StructField("mode", T.LongType()),
    T.StructField("uid", T.LongType()),
    T.StructField("gid", T.LongType()),
    T.StructField("nlink", T.LongType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("atime", T.LongType()),
    T.StructField("ctime", T.LongType()),
])

METADATA = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
BIG_DIRS = T.StructType([T.StructField("path", T.StringType()), T.StructField("file_count", T.LongType())])

FILE, DIRECTORY, SYMLINK, UNKNOWN = 0, 1, 2, 255
