"""Fixed vocabulary of program graphs and the schemas of their tables.

Tables: ``nodes(app, id, type, name, sig, ...)`` and ``edges(app, ord, source, target, relation)``; an app's edges
keep at most one relation per (source, target).
"""

from pyspark.sql import types as T

# Fixed values
PRIMITIVE_TYPES = ["void", "int", "short", "long", "float", "double", "boolean", "byte", "char"]
STATIC_NODE_TYPES = ["package_lib", "class_lib", "method_lib", "field_lib", "const", "modifier", "type"]
KNOWN_NODE_TYPES = ["package_lib", "class_lib", "method_lib", "field_lib", "modifier", "type"]
INCLUDED_NODE_TYPES = [
    "package_lib", "class_lib", "method_lib", "field_lib", "package_3lib", "class_3lib", "method_3lib", "field_3lib",
    "package", "class", "method", "field", "modifier", "type",
]
RELATIONS = [
    "C_C_implement", "C_C_inherit", "C_F_contains", "C_M_contains", "C_M_modifier", "F_C_instance", "F_F_DU", "F_M_DU",
    "F_M_modifier", "F_T_instance", "F_[C_instance", "F_[T_instance", "M_C_parameter", "M_C_refer", "M_C_return", "M_F_DU",
    "M_F_refer", "M_M_modifier", "M_M_override", "M_M_refer", "M_T_parameter", "M_T_return", "M_[C_parameter",
    "M_[C_return", "M_[T_parameter", "M_[T_return", "P_C_contains", "P_P_contains",
]
#: Relations that count for library matching (fixed values)
LIBRARY_RELATIONS = [
    "C_F_contains", "C_M_contains", "C_M_modifier", "F_C_instance", "F_F_DU", "F_M_modifier", "F_T_instance", "F_[C_instance",
    "F_[T_instance", "M_C_parameter", "M_C_refer", "M_C_return", "M_F_DU", "M_F_refer", "M_M_modifier", "M_M_override",
    "M_M_refer", "M_T_parameter", "M_T_return", "M_[C_parameter", "M_[C_return", "M_[T_parameter", "M_[T_return",
    "P_C_contains", "P_P_contains",
]
ROOT_NAME = "DERG_ROOT"  # the reserved name of the root package in graph files
SHORT_NAMES = "os;tv;up;go;it;do;io;id;of;op;on;or;uk;ui;"
EDGE_FAMILIES = ["OO", "TY", "MD", "CR", "DU", "UO", "UA"]
DEFAULT_FAMILIES = ["OO", "TY", "MD", "DU", "CR"]
ABLATION_ORDER = ["OO", "TY", "MD", "CR", "DU", "UO"]
ORDER_EDGE = "UO_MF_MF"
START, END, UNKNOWN = "<start>", "<end>", "<unknown>"

NODE = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("type", "name", "sig", "original_name", "deguard_name", "recovered_name", "recovered_sig", "hash")]])
EDGE = T.StructType([T.StructField("source", T.LongType()), T.StructField("target", T.LongType()), T.StructField("relation", T.StringType())])
GRAPH_FILE = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE)), T.StructField("_corrupt_record", T.StringType())])
FEATURE_FILE = "query array<struct<a:long,b:long,f2:string,cn:string,n:array<long>>>, assign array<struct<v:long,giv:string,inf:string>>"
