"""Declared schemas of the catalogue inputs; readers never infer."""

from pyspark.sql import types as T

LOCATION = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("checksum", T.StringType()),
    T.StructField("has_checksum", T.BooleanType()),
    T.StructField("creation_time", T.TimestampNTZType()),
    T.StructField("creation_place", T.StringType()),
    T.StructField("pax_version", T.StringType()),
    T.StructField("pax_hash", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("checksumproblem", T.BooleanType()),
    T.StructField("rse", T.ArrayType(T.StringType())),
    T.StructField("rule_info", T.ArrayType(T.StringType())),
])

RUNS = T.StructType([
    T.StructField("number", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("detector", T.StringType()),
    T.StructField("start", T.TimestampNTZType()),
    T.StructField("end", T.TimestampNTZType()),
    T.StructField("user", T.StringType()),
    T.StructField("source", T.StructType([T.StructField("type", T.StringType())])),
    T.StructField("tags", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    T.StructField("trigger", T.StructType([T.StructField("events_built", T.LongType())])),
    T.StructField("reader", T.StructType([
        T.StructField("self_trigger", T.BooleanType()),
        T.StructField("ini", T.StructType([
            T.StructField("write_mode", T.IntegerType()),
            T.StructField("events_per_file", T.IntegerType()),
        ])),
    ])),
    T.StructField("raw_size_byte", T.LongType()),
    T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("gains", T.ArrayType(T.DoubleType())),
    T.StructField("correction_versions", T.MapType(T.StringType(), T.StringType())),
    T.StructField("data", T.ArrayType(LOCATION)),
])

CORRECTIONS = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("calculation_time", T.TimestampNTZType()),
    T.StructField("version", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("function", T.StringType()),
    T.StructField("correction", T.ArrayType(T.StructType([
        T.StructField("min", T.LongType()),
        T.StructField("max", T.LongType()),
        T.StructField("value", T.StringType()),
    ]))),
])

SITES = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("dir_raw", T.StringType()),
    T.StructField("dir_processed", T.StringType()),
    T.StructField("dir_minitrees", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("upload_options", T.ArrayType(T.StringType())),
    T.StructField("download_options", T.ArrayType(T.StringType())),
    T.StructField("data_type", T.ArrayType(T.StringType())),
    T.StructField("purge", T.IntegerType()),
    T.StructField("pax_version_purge", T.StringType()),
    T.StructField("nstreams", T.IntegerType()),
    T.StructField("grid_cert", T.StringType()),
])

RULES = T.StructType([
    T.StructField("verification_only", T.BooleanType()),
    T.StructField("run_nb", T.StringType()),
    T.StructField("run_nb_exclude", T.StringType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("run_name_exclude", T.StringType()),
    T.StructField("detector_type", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("destination_rse", T.ArrayType(T.StringType())),
    T.StructField("destination_livetime", T.MapType(T.StringType(), T.StringType())),
    T.StructField("remove_rse", T.ArrayType(T.StringType())),
])
