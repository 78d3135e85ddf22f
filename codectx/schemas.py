"""Row types."""

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())

CODE_CHUNK = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
    T.StructField("chunk_type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("defined_symbols", _strings),
    T.StructField("used_symbols", _strings), T.StructField("call_names", _strings), T.StructField("parent_class", T.StringType()),
    T.StructField("class_bases", _strings), T.StructField("method_names", _strings),
])
REPO_FILE = T.StructType([T.StructField("first", T.BooleanType()), T.StructField("path", T.StringType()), T.StructField("content", T.StringType())])
HISTORY = T.StructType([
    T.StructField("epoch", T.IntegerType()), T.StructField("avg_quality", T.DoubleType()), T.StructField("retrieval_rate", T.DoubleType()),
    T.StructField("dpo_pairs", T.IntegerType()), T.StructField("gate_loss", T.DoubleType()), T.StructField("prompt_loss", T.DoubleType()),
])
AST_NODE = T.StructType([
    T.StructField("doc", T.StringType()), T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()), T.StructField("sibling_pos", T.IntegerType()),
    T.StructField("type", T.StringType()), T.StructField("start_byte", T.IntegerType()), T.StructField("end_byte", T.IntegerType()), T.StructField("start_row", T.IntegerType()),
    T.StructField("start_col", T.IntegerType()), T.StructField("end_row", T.IntegerType()), T.StructField("end_col", T.IntegerType()), T.StructField("nws", T.IntegerType()), T.StructField("leaf", T.BooleanType()),
])
