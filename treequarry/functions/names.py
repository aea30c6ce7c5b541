"""What names say: standard functions, which traces can leave out; tests, hooks and components; style sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treequarry.functions import paths as P

#: Fixed values.
STD = (
    "unwrap expect ok err map and_then or_else unwrap_or unwrap_or_else is_some is_none is_ok is_err "
    "iter into_iter next filter collect fold for_each count sum product any all find position enumerate zip chain take skip rev "
    "to_string to_owned clone as_str as_ref into from parse trim split join replace push push_str pop len is_empty contains starts_with ends_with "
    "insert remove get first last sort reverse extend append clear resize truncate "
    "parent exists is_file is_dir file_name extension to_path_buf canonicalize read_dir components "
    "read_to_string write read open create flush "
    "as_mut as_ptr as_slice to_vec to_bytes default new drop copy eq cmp partial_cmp to_os_string into_string display to_string_lossy "
    "assert assert_eq assert_ne panic print println eprint eprintln format writeln "
    "str int float bool list dict set tuple type isinstance issubclass hasattr getattr setattr delattr range sorted reversed min max abs round id hash repr super property staticmethod classmethod object "
    "Exception ValueError TypeError KeyError IndexError AttributeError RuntimeError NotImplementedError StopIteration"
).split()


def is_std(name: Column) -> Column:
    return name.isin(STD) | name.startswith("test_0_")


def is_go_test_file(path: Column) -> Column:
    return F.endswith(P.stem(path), F.lit("_test"))


def is_go_test(name: Column) -> Column:
    return name.rlike("^(Test|Benchmark|Example)")


def is_zig_test(name: Column) -> Column:
    return name.rlike("^(test|bench)")


def is_tsx(path: Column) -> Column:
    return F.coalesce(P.extension(path) == "tsx", F.lit(False))


def is_scss(path: Column) -> Column:
    return F.coalesce(P.extension(path).isin("scss", "sass"), F.lit(False))


def is_react_hook(name: Column) -> Column:
    """`use` and a capital."""
    return name.rlike(r"^use\p{Lu}")


def is_react_component(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def has_tailwind(path: Column, content: Column) -> Column:
    """By the file's name or a directive in it."""
    return F.contains(P.file_name(path), F.lit("tailwind")) | content.rlike("@(tailwind|apply|layer)")
