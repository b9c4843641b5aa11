"""Where files come from: folders of all executors' storage, tables of texts, snapshots of repositories."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from auditgrid.functions.text import matches
from auditgrid.schema import FILES_DDL

# What is scanned at all.
PRUNED = ("node_modules", ".git", ".next", ".nuxt", "dist", "build", ".output", ".vercel", ".netlify", "coverage", "__pycache__", ".venv", "venv", ".svelte-kit")
EXTENSIONS = (
    ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue", ".svelte", ".json", ".env", ".yaml", ".yml", ".toml", ".html", ".htm", ".css", ".py", ".rb", ".go", ".rs", ".php", ".java", ".kt", ".swift", ".dart",
    ".rules", ".lock",
)
ALWAYS = (
    ".env", ".env.local", ".env.production", ".env.development", ".env.staging", ".env.test", ".gitignore", ".dockerignore", "firestore.rules", "storage.rules", "database.rules.json", "firebase.json", "vercel.json",
    "netlify.toml", "docker-compose.yml", "docker-compose.yaml", "Dockerfile", ".htaccess", "nginx.conf",
)
MAX_BYTES = 2 * 1024 * 1024


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)\z", 1))


def scanned(path: Column) -> Column:
    """Whether a file is scanned by its extension (in lower case; a leading dot starts none) or its name."""
    return extension(path).isin(*EXTENSIONS) | basename(path).isin(*ALWAYS)


def pruned(path: Column, ignore: tuple[str, ...] = ()) -> Column:
    """Whether a folder on the path is left out."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    names = [*PRUNED, *(x.rstrip("/") for x in ignore)]
    return F.exists(folders, lambda f: f.isin(*names))


def ignored(path: Column, ignore: tuple[str, ...]) -> Column:
    """Whether any part of the path, the file's name included, is an entry of the ignore list."""
    names = [x.rstrip("/") for x in ignore]
    return F.exists(F.split(path, "/"), lambda f: f.isin(*names)) if names else F.lit(False)


def scan_predicate(path: Column, content: Column, ignore: tuple[str, ...] = (), keep_empty: bool = False) -> Column:
    """The scan's filter for a table of files; snapshots of remote repositories keep empty files."""
    size = F.octet_length(content)
    return scanned(path) & ~pruned(path, ignore) & (size <= MAX_BYTES) & (F.lit(True) if keep_empty else size > 0)


class _Bin(InputPartition):
    """Folders to walk and files to read, by the executor that gets them."""

    def __init__(self, folders: list[str], files: list[str]) -> None:
        super().__init__(folders)
        self.folders, self.files = folders, files


def file_id(repo: str, path: str) -> int:
    """63 bits of a hash of both names."""
    return int.from_bytes(hashlib.blake2b(f"{repo}\0{path}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


#: Filters that the source answers itself, as tests of a value.
_TESTS = {
    EqualTo: lambda f, x: x == f.value, In: lambda f, x: x in f.value, StringStartsWith: lambda f, x: x.startswith(f.value), StringEndsWith: lambda f, x: x.endswith(f.value), StringContains: lambda f, x: f.value in x,
}


class _FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.repo = options.get("repo", os.path.basename(self.root))
        self.ignore = {*PRUNED, *filter(None, (x.strip().rstrip("/") for x in options.get("ignore", "").split(",")))}
        self.bins = int(options.get("partitions", "64"))
        self.asked: dict[str, list[Filter]] = {"repo": [], "relative_path": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality, lists and parts of relative_path and repo are the source's own: files that they leave out are never opened."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.asked:
                self.asked[f.attribute[0]].append(f)
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return all(_TESTS[type(f)](f, value) for f in self.asked[column])

    def _leads_on(self, folder: str) -> bool:
        """Whether a folder can hold a path that the filters leave: one that begins with what they ask for, or the other way round."""
        below = os.path.relpath(folder, self.root).replace(os.sep, "/") + "/"
        for f in self.asked["relative_path"]:
            firsts = [f.value] if isinstance(f, (EqualTo, StringStartsWith)) else list(f.value) if isinstance(f, In) else None
            if firsts is not None and not any(x.startswith(below) or (isinstance(f, StringStartsWith) and below.startswith(x)) for x in firsts):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """The driver lists folders level by level until there are enough to deal out; the executors walk them."""
        if not self._wanted("repo", self.repo):
            return [_Bin([], [])]
        folders, files = [self.root], []
        while folders and len(folders) < self.bins:
            below = []
            for folder in folders:
                for entry in os.scandir(folder):
                    if entry.is_dir(follow_symlinks=False):
                        if entry.name not in self.ignore and self._leads_on(entry.path):
                            below.append(entry.path)
                    else:
                        files.append(entry.path)
            folders = below
        n = min(self.bins, len(folders) + len(files)) or 1
        folders, files = sorted(folders), sorted(files)
        return [_Bin(folders[i::n], files[i::n]) for i in range(n)]

    def _paths(self, partition: _Bin) -> Iterator[str]:
        yield from partition.files
        for top in partition.folders:
            for folder, names, files in os.walk(top):
                names[:] = sorted(n for n in names if n not in self.ignore and self._leads_on(os.path.join(folder, n)))
                yield from (os.path.join(folder, f) for f in sorted(files))

    def read(self, partition: _Bin) -> Iterator[tuple]:
        for path in self._paths(partition):
            name = os.path.basename(path)
            if os.path.splitext(name)[1].lower() not in EXTENSIONS and name not in ALWAYS:
                continue
            relative = os.path.relpath(path, self.root).replace(os.sep, "/")
            if not self._wanted("relative_path", relative):
                continue
            try:
                if not os.path.isfile(path) or not 0 < os.path.getsize(path) <= MAX_BYTES:
                    continue
                with open(path, "rb") as f:
                    content = f.read().decode("utf-8", "replace")
            except OSError:
                continue
            yield file_id(self.repo, relative), self.repo, relative, content


class CodeFiles(DataSource):
    """``spark.read.format("codefiles").load(folder)``: hidden files included, which Spark's own sources leave out.

    Filters on relative_path and repo reach the source, so only matching files are opened, where
    ``spark.sql.python.filterPushdown.enabled`` is set (``folder`` sets it). Options: repo (name, else the folder's), ignore (comma-separated names), partitions. The folder must be
    reachable from the driver and all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "codefiles"

    def schema(self) -> str:
        return FILES_DDL

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader(self.options)


def folder(spark: SparkSession, path: str, repo: str | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    spark.dataSource.register(CodeFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("codefiles").option("ignore", ",".join(ignore))
    return (reader.option("repo", repo) if repo else reader).load(path)


def snapshots(files: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Files of staged repository snapshots (repo, relative_path, content) that a remote scan would read."""
    return files.where(scan_predicate(F.col("relative_path"), F.col("content"), ignore, keep_empty=True))


def parse_target(target: Column) -> Column:
    """``struct<owner, repo>`` of a repository's address or ``owner/repo``; null otherwise."""
    url = r"^(?:https?:\/\/)?github\.com[\/:]([^\/\s]+)\/([^\/\s#?.]+?)(?:\.git)?(?:[\/#?].*)?\z"
    short = r"^([A-Za-z0-9_-][A-Za-z0-9_.-]*)\/([A-Za-z0-9_.-]+)\z"
    made = lambda p: F.struct(F.regexp_extract(target, p, 1).alias("owner"), F.regexp_extract(target, p, 2).alias("repo"))
    return F.when(target.rlike(url), made(url)).when(target.rlike(short), made(short))


def client_error(status: Column, remaining: Column, body: Column, retry_after: Column, reset: Column, now: Column) -> Column:
    """``struct<rate_limited, retry_after_ms>`` of a failed request to a repository host."""
    limited = (status == 429) | ((status == 403) & ((remaining == "0") | matches(F.coalesce(body, F.lit("")), "rate limit", "i")))
    wait = F.when(retry_after.isNotNull(), retry_after.cast("long") * 1000).when(reset.isNotNull(), F.greatest(F.lit(0).cast("long"), (reset.cast("long") - now.cast("long")) * 1000))
    return F.struct(F.coalesce(limited, F.lit(False)).alias("rate_limited"), wait.alias("retry_after_ms"))
