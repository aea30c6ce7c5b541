"""Columns of path strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are scanned; languages by extension; languages that hold code.
SUPPORTED = ["rs", "go", "ts", "tsx", "js", "jsx", "py", "sh", "bash", "tf", "tfvars", "hcl", "yaml", "yml", "html", "htm", "css", "xml", "md", "zig"]
LANGUAGES = {
    "rust": ["rs"],
    "typescript": ["ts", "tsx"],
    "python": ["py", "pyi"],
    "bash": ["sh", "bash"],
    "terraform": ["tf", "tfvars", "hcl"],
    "helm": ["yaml", "yml"],
    "go": ["go"],
    "zig": ["zig"],
    "html": ["html", "htm"],
    "css": ["css", "scss", "sass"],
    "xml": ["xml"],
    "markdown": ["md", "markdown", "mdown", "mkd"],
}
CODE = ["rust", "typescript", "python", "go", "zig"]
#: How languages are written in output.
SHOWN = {"rust": "Rust", "typescript": "TypeScript", "python": "Python", "bash": "Bash/Shell", "terraform": "Terraform/HCL", "helm": "Helm/YAML", "go": "Go", "zig": "Zig", "html": "HTML", "css": "CSS", "xml": "XML", "markdown": "Markdown"}
#: Extensions of binary files; folders of version control.
BINARY = ["exe", "dll", "so", "dylib", "bin", "o", "a", "lib", "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "mp3", "mp4", "avi", "mov", "mkv", "wav", "flac", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "sqlite", "db", "mdb"]
VCS = [".git/", ".svn/", ".hg/", ".cvs/", ".bzr/", ".fslckout/", "_FOSSIL_/", "_darcs/", "CVS/"]
CONFIG_FILE, DATA_DIR = ".treequarry_config", ".treequarry"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """After the last dot of the file name, null without one or where the name only starts with it."""
    found = F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(file_name(path).rlike(r"^.+\.[^.]*$"), found)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def normalized(path: Column, root: str) -> Column:
    """Relative to the root, with forward slashes."""
    return F.regexp_replace(F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path), r"\\", "/")


def supported(path: Column) -> Column:
    return F.coalesce(extension(path).isin(SUPPORTED), F.lit(False))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for name, extensions in LANGUAGES.items() for e in extensions for x in (e, name)])
    return F.coalesce(F.try_element_at(known, F.coalesce(extension(path), F.lit(""))), F.lit("unknown"))


def language_name(name: Column) -> Column:
    """A language as output writes it."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair]), name), F.lit("Unknown"))


def is_code(path: Column) -> Column:
    return language(path).isin(CODE)


def is_binary(path: Column, content: Column) -> Column:
    """By extension, or a zero byte among the first 8 KiB."""
    head = F.substring(content.cast("binary"), 1, 8192)
    return F.coalesce(F.lower(extension(path)).isin(BINARY), F.lit(False)) | F.coalesce(F.instr(F.decode(head, "ISO-8859-1"), "\0") > 0, F.lit(False))


def is_vcs(path: Column) -> Column:
    out = F.lit(False)
    for folder in VCS:
        out = out | F.startswith(path, F.lit(folder)) | F.contains(path, F.lit("/" + folder))
    return out


def is_config(path: Column, config_file: str = CONFIG_FILE) -> Column:
    return path == config_file


def in_data_dir(path: Column, data_dir: str = DATA_DIR) -> Column:
    """A bare prefix: whatever begins with the folder's name is protected."""
    return F.startswith(path, F.lit(data_dir))


def glob_regex(pattern: str) -> str:
    """* and ? stay within a folder, ** crosses folders, [..] is a class with ! for its complement."""
    out, i = "^", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end + 1
        else:
            out, i = out + (("\\" if not pattern[i].isalnum() and pattern[i] not in "_/-" else "") + pattern[i]), i + 1
    return out + "$"


def path_error(path: Column) -> Column:
    """The code of what makes a path or pattern invalid, else null; the first that holds counts."""
    return (
        F.when(F.startswith(path, F.lit("./")) | F.startswith(path, F.lit("../")), "E001")
        .when(F.startswith(path, F.lit(".")), "E002")
        .when(path.rlike(r"[\x00-\x1f\x7f]"), "E023")
        .when(is_config(path), "E018")
        .when(in_data_dir(path), "E019")
        .when(is_vcs(path), "E020")
    )
