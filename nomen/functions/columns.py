"""Column expressions on node types, signatures and names.  All run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nomen import model

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def before_last_dot(x: Col, strict: bool = False) -> Column:
    """The part before the last dot.  Without a dot: empty; ``strict`` drops the last character instead."""
    x = _c(x)
    at = F.length(x) - F.length(F.substring_index(x, ".", -1))
    bare = F.substring(x, F.lit(1), F.length(x) - 1) if strict else F.lit("")
    return F.when(F.contains(x, F.lit(".")), F.substring(x, F.lit(1), at - 1)).otherwise(bare)


def belonging_package(type_: Col, sig: Col, strict: bool = False) -> Column:
    """Package of a package, class, method or field; null for other types."""
    t, s = _c(type_), _c(sig)
    owner = F.regexp_extract(s, r"^<(.*?): ", 1)
    return F.when(t.startswith("package"), s).when(t.startswith("class"), before_last_dot(s, strict)).when(t.startswith("method") | t.startswith("field"), before_last_dot(owner, strict))


def is_static(type_: Col) -> Column:
    return _c(type_).isin(model.STATIC_NODE_TYPES)


def can_be_minified(type_: Col, name: Col) -> Column:
    """Every type that is not static, and the ``volatile`` modifier."""
    return ~is_static(type_) | F.coalesce((_c(type_) == "modifier") & (_c(name) == "volatile"), F.lit(False))


def is_hashable(type_: Col) -> Column:
    return _c(type_).rlike("^(class|method|field)") & ~_c(type_).endswith("_lib")


def is_known(type_: Col, name: Col) -> Column:
    return _c(type_).isin(model.KNOWN_NODE_TYPES) | ((_c(type_) == "package") & (_c(name) == model.ROOT_NAME))


def is_included(type_: Col, include_3lib: bool = False) -> Column:
    found = _c(type_).isin(model.INCLUDED_NODE_TYPES)
    return found if include_3lib else found & ~_c(type_).endswith("_3lib")


def entity_name(type_: Col, name: Col, sig: Col) -> Column:
    """Known nodes: ``type:sig`` with blanks as ``~``; others: their raw name."""
    return F.when(is_known(type_, name), F.concat(_c(type_), F.lit(":"), F.translate(_c(sig), " ", "~"))).otherwise(_c(name))


def global_id(app: Col, id_: Col) -> Column:
    return F.concat(_c(app), F.lit("->node:"), _c(id_).cast("string"))


def member_key(sig: Col, type_: Col) -> Column:
    """``<c: T n>`` to ``c;->n:T`` for fields, ``<c: R n(ps)>`` to ``c;->n(ps)`` for methods (null if malformed); others unchanged."""
    s, t = _c(sig), _c(type_)
    field, method = r"^<(.+): (.+) (.+)>", r"^<(.+): (.+) (.+)\((.*)\)>"
    part = lambda p, i: F.regexp_extract(s, p, i)
    return (
        F.when(t.startswith("field"), F.when(s.rlike(field), F.concat(part(field, 1), F.lit(";->"), part(field, 3), F.lit(":"), part(field, 2))))
        .when(t.startswith("method"), F.when(s.rlike(method), F.concat(part(method, 1), F.lit(";->"), part(method, 3), F.lit("("), part(method, 4), F.lit(")"))))
        .otherwise(s)
    )


def array_element_type(type_: Col, name: Col) -> Column:
    """Element type name of ``type`` nodes that are arrays (all dimensions dropped), else null."""
    return F.when((_c(type_) == "type") & _c(name).endswith("[]"), F.substring_index(_c(name), "[", 1))


def qualify_relation(source_type: Col, target_type: Col, relation: Col, source_array: Col | None = None, target_array: Col | None = None) -> Column:
    """``XX_verb`` to ``S_T_verb`` by the endpoint types' first letters, with ``[`` before the element type of an array."""
    letter = lambda t, a: F.concat(F.when(_c(a), "[").otherwise("") if a is not None else F.lit(""), F.upper(F.substring(_c(t), 1, 1)))
    return F.concat(letter(source_type, source_array), F.lit("_"), letter(target_type, target_array), F.substring(_c(relation), 3, 1 << 20))


def _first_part(name: Column, skip_r: bool) -> Column:
    usable = lambda s: (F.length(s) > 0) & (s != "R") if skip_r else F.length(s) > 0
    return F.lower(F.coalesce(F.try_element_at(F.filter(F.split(name, r"\$"), usable), F.lit(1)), name))


def is_name_obfuscated(name: Col) -> Column:
    """A null name, or a first ``$`` part of less than two letters, or of two that the list of short names lacks.

    The list is searched as one string, so ``s;`` counts as listed.
    """
    n = _c(name)
    part = _first_part(n, False)
    return n.isNull() | (F.length(part) < 2) | ((F.length(part) == 2) & ~F.contains(F.lit(model.SHORT_NAMES), part))


def is_class_name_obfuscated(name: Col) -> Column:
    """As for names, but ``R`` is never obfuscated and ``R`` parts are skipped."""
    n = _c(name)
    part = _first_part(n, True)
    return n.isNull() | ((n != "R") & ((F.length(part) < 2) | ((F.length(part) == 2) & ~F.contains(F.lit(model.SHORT_NAMES), part))))


def is_method_minified(id_: Col) -> Column:
    """Dotted ids of two parts or more whose last or last but one part (before ``$``) has one letter."""
    parts = F.split(_c(id_), r"\.")
    short = lambda i: F.length(F.substring_index(F.try_element_at(parts, F.lit(i)), "$", 1)) == 1
    return (F.size(parts) >= 2) & F.coalesce(short(-1) | short(-2), F.lit(False))


def names_compatible(library: Col, minified: Col) -> Column:
    """As many dotted parts, and every minified part longer than 3 equals the library's."""
    a, b = F.split(_c(library), r"\."), F.split(_c(minified), r"\.")
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (F.length(y) <= 3) | (x == y)), lambda ok: F.coalesce(ok, F.lit(False)))


def free_name(taken: list[str], name: str) -> str:
    """``name``, made longer until no column is called so."""
    while name.lower() in map(str.lower, taken):
        name += "_"
    return name


NAME_WORDS = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$|_)|<init>|<clinit>|\$"  # fixed value


def split_name(name: Col) -> Column:
    """Lower-case words of a camel, underscore or mixed name."""
    return F.transform(F.regexp_extract_all(_c(name), F.lit(NAME_WORDS), F.lit(0)), F.lower)


def trigrams(name: Col) -> Column:
    n = F.lower(_c(name))
    return F.when(F.length(n) >= 3, F.transform(F.sequence(F.lit(1), F.length(n) - 2), lambda i: F.substring(n, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def common_substring(a: Col, b: Col) -> Column:
    """Equal, or with a common substring of three letters or more (case ignored)."""
    return F.coalesce((_c(a) == _c(b)) | F.arrays_overlap(trigrams(a), trigrams(b)), F.lit(False))


def safe_divide(a: Col, b: Col) -> Column:
    """a / b, and 1 where b is 0 or less."""
    return F.when(_c(b) <= 0, F.lit(1.0)).otherwise(_c(a) / F.when(_c(b) > 0, _c(b)))


def percent(a: Col, b: Col) -> Column:
    return F.when(_c(b) == 0, F.lit("-")).otherwise(F.format_string("%.2f%%", 100.0 * _c(a) / F.when(_c(b) != 0, _c(b))))


def edge_family(relation: Col) -> Column:
    return F.substring(_c(relation), 1, 2)


def normalise_activity(component: Col, package: Col) -> Column:
    """``pkg/.X`` to ``package.X``; otherwise what follows the slash."""
    tail = F.substring_index(_c(component), "/", -1)
    return F.when(tail.startswith("."), F.concat(_c(package), tail)).otherwise(tail)


def generalise(x: Col) -> Column:
    return F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]", "")


def artifact_parts(path: Col) -> Column:
    """struct(project, variant, kind: mapping, debug, release, skipped or unknown) of a build artifact's path."""
    p = _c(path)
    rules = [  # path patterns: fixed values
        (r"^.*unaligned\.apk$", None, None, "skipped"),
        (r"^(.*)/build/outputs/mapping(.*)/release/mapping\.txt$", 1, 2, "mapping"),
        (r"^(.*)/bin/proguard/mapping\.txt$", 1, None, "mapping"),
        (r"^(.*)/build/outputs/apk/(.*)-debug\.apk$", 1, 2, "debug"),
        (r"^(.*)/build/outputs/apk/(.*)-release(-unsigned)?\.apk$", 1, 2, "release"),
        (r"^(.*)/bin/.*-debug\.apk$", 1, None, "debug"),
        (r"^(.*)/bin/.*-release(-unsigned)?\.apk$", 1, None, "release"),
    ]
    out = None
    for pattern, project, variant, kind in rules:
        got = F.struct((F.regexp_extract(p, pattern, project) if project else F.lit(None).cast("string")).alias("project"), (F.regexp_extract(p, pattern, variant) if variant else F.lit("") if project else F.lit(None).cast("string")).alias("variant"), F.lit(kind).alias("kind"))
        out = F.when(p.rlike(pattern), got) if out is None else out.when(p.rlike(pattern), got)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("variant"), F.lit("unknown").alias("kind")))


def translate_types(types: Col, mapping: Col) -> Column:
    """A comma list of type names with each changed class replaced (whole names only, so ``Foo[]`` stays)."""
    return F.array_join(F.transform(F.split(_c(types), ","), lambda t: F.coalesce(F.try_element_at(_c(mapping), t), t)), ",")
