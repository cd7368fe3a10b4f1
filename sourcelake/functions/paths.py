"""Path and content predicates of the inventory, as column expressions (JVM side throughout)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# They must equal those of the contract.
LANGUAGE_EXTENSIONS = {
    "php": ["php", "phtml", "php3", "php4", "php5", "php7", "php8"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx", "mts", "cts"],
    "python": ["py", "pyi", "pyw"],
    "json": ["json", "jsonc", "jsonl"],
    "yaml": ["yaml", "yml"],
    "toml": ["toml"],
    "markdown": ["md", "markdown", "mdx"],
    "shell": ["sh", "bash", "zsh", "fish"],
    "rust": ["rs"],
}
LANGUAGES = [*LANGUAGE_EXTENSIONS, "unknown"]
SOURCE_LANGUAGES = ["php", "javascript", "typescript", "python", "shell", "rust"]
GENERATED_SUFFIXES = [".min.js", ".min.css", ".generated.ts", ".generated.js", ".g.dart"]
LOCK_FILES = ["Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "poetry.lock", "uv.lock"]
GENERATED_MARKS = ["@generated file", "code generated"]
MANIFESTS = {
    "composer.json": "composer", "package.json": "npm", "Cargo.toml": "cargo", "go.mod": "go", "requirements.txt": "python_requirements", "pyproject.toml": "python_pyproject", "Gemfile": "bundler", "pom.xml": "maven",
    "build.gradle": "gradle", "build.gradle.kts": "gradle", "Dockerfile": "docker", "docker-compose.yml": "compose", "docker-compose.yaml": "compose", "compose.yml": "compose", "compose.yaml": "compose",
}
TEST_DIRECTORIES = ["test", "tests", "__tests__", "spec", "specs"]
DOC_DIRECTORIES = ["doc", "docs"]
EXCLUDED_DIRECTORIES = ["node_modules", "vendor", "target", "dist", "build", "coverage", ".cache"]
UNSAFE_CHARACTERS = r"[\p{Cc}\x{061C}\x{200E}\x{200F}\x{2028}-\x{202E}\x{2066}-\x{2069}]"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def language(path: Column) -> Column:
    """By extension, through a constant map: the path is evaluated once."""
    pairs = [F.lit(x) for name, exts in LANGUAGE_EXTENSIONS.items() for e in exts for x in (e, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("unknown"))


def language_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LANGUAGES)), name)


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def is_binary(content: Column) -> Column:
    return ~is_utf8(content) | (F.position(F.lit(b"\x00"), content.cast("binary")) > 0)


def is_generated(path: Column, content: Column) -> Column:
    name = file_name(path)
    head = F.lower(F.decode(F.substring(content.cast("binary"), 1, 2048), "ISO-8859-1"))
    out = name.isin(LOCK_FILES)
    for s in GENERATED_SUFFIXES:
        out = out | name.endswith(s)
    for m in GENERATED_MARKS:
        out = out | head.contains(m)
    return out


def line_count(text: Column) -> Column:
    """Newlines, and one for a last line without one; of an empty text 0."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (newlines + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("long")


def manifest_kind(path: Column) -> Column:
    pairs = [F.lit(x) for kv in MANIFESTS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), file_name(path))


def is_test(path: Column) -> Column:
    low = F.lower(path)
    name = file_name(low)
    inside = F.exists(F.split(low, "/"), lambda p: p.isin(TEST_DIRECTORIES))
    return inside | name.rlike(r"^test_|_test\.(py|go)$|\.(test|spec)\.|(test|spec)\.php$")


def is_documentation(path: Column) -> Column:
    low = F.lower(path)
    name = file_name(low)
    return F.exists(F.split(low, "/"), lambda p: p.isin(DOC_DIRECTORIES)) | name.rlike(r"\.(md|mdx|rst)$|^readme$|^readme\.|^changelog$")


def source_stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(file_name(path), r"\.[^.]*$", ""))


def test_stem(path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(file_name(path), r"\.[^.]*$", ""), "^test_", "")
    return F.lower(F.regexp_replace(stem, r"(_test|\.test|\.spec)$", ""))


def excluded_by_engine(path: Column) -> Column:
    """A Git directory anywhere, in any case, or one of the build directories as a directory component."""
    parts = F.split(path, "/")
    directories = F.slice(parts, 1, F.size(parts) - 1)
    return F.exists(parts, lambda p: F.lower(p) == ".git") | F.exists(directories, lambda p: p.isin(EXCLUDED_DIRECTORIES))


def normalized(path: Column) -> Column:
    """The path without ``.`` and empty parts; null where the contract rejects it."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    bad = (F.octet_length(path) > 4096) | path.contains("\\") | path.rlike(UNSAFE_CHARACTERS) | path.startswith("/") | path.rlike("^[A-Za-z]:") | F.exists(parts, lambda p: p == "..") | (F.size(parts) > 256) | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def is_oid(value: Column) -> Column:
    return value.rlike("^(?:[0-9a-f]{40}|[0-9a-f]{64})$")


def is_mutable_reference(use: Column) -> Column:
    """Whether a workflow's ``uses`` is not pinned: local ones are, images by digest, actions by a full commit."""
    return ~use.startswith("./") & ~F.when(use.startswith("docker://"), use.rlike("@sha256:[0-9a-f]{64}$")).otherwise(use.rlike("@[0-9a-f]{40}$"))


def glob_regex(pattern: str, below: bool = True) -> str:
    """Java regex for a root-relative ignore pattern: ``*`` and ``?`` stop at ``/``, ``**`` does not, a pattern without a slash fits at any depth, a match covers what lies below if ``below``."""
    import re

    body = pattern.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            cls = body[i + 1 : end]
            out, i = out + "[" + ("^" + cls[1:] if cls[0] == "!" else cls) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    rest = "" if not below else "/.*" if pattern.endswith("/") else "(?:/.*)?"
    return f"^{'' if anchored else '(?:.*/)?'}{out}{rest}$"


def excluded_by_user(path: Column, patterns: list[str]) -> Column:
    """Ignore patterns in order; the last one that fits decides, and ``!`` takes back."""
    out = F.lit(False)
    for p in patterns:
        keep = p.startswith("!")
        out = F.when(path.rlike(glob_regex(p[1:] if keep else p)), F.lit(not keep)).otherwise(out)
    return out


def is_object_id(value):
    """40 or 64 lower-case hexadecimal digits that are not all zero; null is none."""
    return F.coalesce(value.rlike("^(?:[0-9a-f]{40}|[0-9a-f]{64})$") & ~value.rlike("^0+$"), F.lit(False))


def relative_uri(path):
    """The path with every byte outside ``A-Z a-z 0-9 - . _ ~ /`` escaped."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
