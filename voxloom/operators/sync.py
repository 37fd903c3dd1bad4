"""What is synchronised, what has to be done about it, and how it stands, for all paths at once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import basename, glob_match, is_audio_path, under
from voxloom.operators.scan import salted_join

# Statuses by the attention they need, the most urgent first.
STATUSES = ("conflict", "pending_delete", "pending_download", "pending_upload", "excluded", "deleted_local_kept_remote", "never_synced", "synced")
QUIET = ("synced", "never_synced", "deleted_local_kept_remote")
# Groups of a project's files by name; recordings are told by their extension, and the rest is meta.
FILE_GROUPS = {
    "summary-brief.md": "brief",
    "summary-detailed.md": "detailed",
    "mindmap.mmd": "mindmap",
    "mindmap-outline.md": "mindmap",
    "transcript.md": "transcript",
    "transcript.json": "transcript",
    "transcript.srt": "transcript",
}
# What a project is expected to hold, in the order in which missing parts are named.
ARTIFACTS = (("transcript", "transcript.md"), ("detailed", "summary-detailed.md"), ("brief", "summary-brief.md"), ("mindmap", "mindmap.mmd"))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def project_of(path: str | Column) -> Column:
    """The folder of a project that a path lies in; null outside of projects."""
    return F.nullif(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"^projects/([^/]+)", 1), F.lit(""))


def project_matches(folder: str | Column, selector: str) -> Column:
    """Whether a project's folder is meant by selector: its name, a beginning with an underscore, or a whole date before _ or /."""
    name, s = F.col(folder) if isinstance(folder, str) else folder, selector.strip()
    if not s:
        return F.lit(False)
    starts = name.startswith(s)
    if "_" not in s:
        date = len(s) == 10 and s[4] == s[7] == "-" and (s[:4] + s[5:7] + s[8:]).isascii() and (s[:4] + s[5:7] + s[8:]).isdigit()
        starts = starts & F.substring(name, len(s) + 1, 1).isin("_", "/") if date else F.lit(False)
    return F.coalesce((name == s) | starts, F.lit(False))


@dataclass(frozen=True)
class Selection:
    """What takes part in synchronisation.

    include and exclude are patterns, projects selectors (given these, patterns
    don't count); without any of them everything is in scope. excluded are single
    paths or folders left out. direction: both, upload or download; deletion: keep,
    text (all but recordings) or mirror; audio: whether recordings take part.
    """

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    projects: tuple[str, ...] | None = None
    excluded: tuple[str, ...] = field(default=())
    direction: str = "both"
    deletion: str = "keep"
    audio: bool = True

    @property
    def uploads(self) -> bool:
        return self.direction in ("both", "upload")

    @property
    def downloads(self) -> bool:
        return self.direction in ("both", "download")

    @property
    def downloads_audio(self) -> bool:
        return self.audio and self.downloads

    @property
    def deletes_anything(self) -> bool:
        return self.deletion != "keep" and self.uploads

    def _holds(self, path: str) -> bool:
        return any(path == e or path.startswith(e + "/") for e in (x.rstrip("/") for x in self.excluded) if e)

    def without(self, path: str) -> Selection:
        """With a path or folder left out; nothing changes if it is already."""
        path = path.rstrip("/")
        return self if not path or self._holds(path) else replace(self, excluded=tuple(sorted({*self.excluded, path})))

    def with_again(self, path: str) -> Selection:
        """With a path or folder, and all below it, no longer left out."""
        path = path.rstrip("/")
        return replace(self, excluded=tuple(e for e in self.excluded if e != path and not e.startswith(path + "/")))

    def user_excluded(self, path: str | Column) -> Column:
        return under(path, [e for e in self.excluded if e.rstrip("/")])

    def wants(self, path: str | Column) -> Column:
        """Whether a path takes part."""
        out = ~self.user_excluded(path)
        if not self.audio:
            out = out & ~is_audio_path(path)
        if self.projects is not None:
            return out & F.coalesce(_any([project_matches(project_of(path), s) for s in self.projects]), F.lit(False))
        out = out & ~_any([glob_match(path, p) for p in self.exclude])
        return out & _any([glob_match(path, p) for p in self.include]) if self.include else out

    def allows_delete(self, path: str | Column) -> Column:
        """Whether deleting a path here may delete it there, by the policy alone."""
        return {"keep": F.lit(False), "mirror": F.lit(True)}.get(self.deletion, ~is_audio_path(path))

    def deletes_remote(self, path: str | Column) -> Column:
        """Whether a deletion here is carried out there."""
        return self.wants(path) & self.allows_delete(path) & F.lit(self.uploads)


ADDITIVE = Selection()
DOWNLOAD_ONLY = Selection(direction="download")
UPLOAD_ONLY = Selection(direction="upload")
MIRROR = Selection(deletion="mirror")


def plan(local: DataFrame, manifest: DataFrame, remote: DataFrame | None, device: str, selection: Selection = ADDITIVE) -> DataFrame:
    """(rel_path, action, local_size, remote_etag): what makes local files and the remote copy agree; each path once at most.

    local (rel_path, size_bytes), manifest (rel_path, etag, origin, deleted_at),
    remote (rel_path, etag) or None without a connection, each path once; paths
    out of scope have no row.

    A local file goes up if the manifest has it as deleted, or if the remote has no
    tag of it; with a tag it is skipped if the manifest knows that tag or none, and
    comes down if it knows another one. What the direction forbids is skipped. A
    file that only the manifest has alive is deleted remotely if this device made
    the entry and selection deletes it, else comes down if the remote has a tag of
    it and the direction allows it. All joins are on the path.
    """
    here = local.where(selection.wants("rel_path")).select("rel_path", F.coalesce("size_bytes", F.lit(0)).cast("long").alias("local_size"))
    known = manifest.where(selection.wants("rel_path")).select("rel_path", F.col("etag").alias("_known"), F.coalesce(F.col("origin") == device, F.lit(False)).alias("_own"), F.col("deleted_at").isNotNull().alias("_dead"))
    rows = here.join(known, "rel_path", "full")
    if remote is None:
        rows = rows.withColumn("_seen", F.lit(None).cast("string"))
    else:
        rows = rows.join(remote.select("rel_path", F.col("etag").alias("_seen")), "rel_path", "left")
    is_here, dead = F.col("local_size").isNotNull(), F.coalesce("_dead", F.lit(False))
    action = F.when(dead | F.col("_seen").isNull(), "upload").when(F.col("_known").isNull() | (F.col("_known") == F.col("_seen")), "skip").otherwise("download")
    forbidden = [a for a, allowed in (("upload", selection.uploads), ("download", selection.downloads)) if not allowed]
    if forbidden:
        action = F.when(action.isin(*forbidden), "skip").otherwise(action)
    other = F.when(~dead & F.col("_own") & selection.deletes_remote("rel_path"), "delete_remote")
    if selection.downloads and remote is not None:
        other = other.when(~dead & F.col("_seen").isNotNull(), "download")
    rows = rows.select("rel_path", F.when(is_here, action).otherwise(other).alias("action"), F.coalesce("local_size", F.lit(0)).alias("local_size"), "_seen", "_known")
    return rows.where("action is not null").select("rel_path", "action", "local_size", F.when(F.col("action") == "delete_remote", F.col("_known")).otherwise(F.col("_seen")).alias("remote_etag"))


def status(files: DataFrame, selection: Selection = ADDITIVE) -> DataFrame:
    """files with in_scope and status, one of STATUSES.

    files: rel_path, local_size (null: not here), synced_size and last_synced_at of
    what was synchronised before (null: never), remote_exists (null: not known).
    """
    here, scope = F.col("local_size").isNotNull(), selection.wants("rel_path")
    gone = F.when(F.col("last_synced_at").isNull(), "never_synced").when(~F.coalesce("remote_exists", F.lit(True)), "synced")
    gone = gone.when(selection.deletes_remote("rel_path"), "pending_delete").otherwise("deleted_local_kept_remote")
    changed = F.coalesce(F.col("local_size") != F.col("synced_size"), F.lit(False))
    kept = F.when(F.col("last_synced_at").isNull(), "never_synced").when(~F.coalesce("remote_exists", F.lit(True)) | changed, "pending_upload").otherwise("synced")
    out = F.when(~scope & here, "excluded").when(~scope, "deleted_local_kept_remote").when(~here, gone).otherwise(kept)
    return files.withColumns({"in_scope": scope, "status": out})


def attention_rank(column: str | Column) -> Column:
    """The place of a status in STATUSES."""
    x = F.col(column) if isinstance(column, str) else column
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), x)


def needs_attention(column: str) -> Column:
    return ~F.col(column).isin(*QUIET)


def known_files(local: DataFrame, state: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files of an inventory: local ones, and those once synchronised that the manifest still has alive.

    local (rel_path, size_bytes), state (rel_path, size_bytes, last_synced_at),
    manifest (rel_path, deleted_at), each path once.
    """
    alive = manifest.where("deleted_at is null").select("rel_path")
    before = state.select("rel_path", F.col("size_bytes").alias("synced_size"), "last_synced_at")
    listed = alive.withColumn("_alive", F.lit(True))
    rows = local.select("rel_path", F.col("size_bytes").alias("local_size")).join(before, "rel_path", "full").join(listed, "rel_path", "left")
    return rows.where(F.col("local_size").isNotNull() | F.col("_alive")).drop("_alive")


def file_group(path: str | Column) -> Column:
    """The group of a file of a project: audio, brief, detailed, mindmap, transcript or meta."""
    name = basename(path)
    out = F.when(is_audio_path(path), "audio")
    for n, group in FILE_GROUPS.items():
        out = out.when(name == n, group)
    return out.otherwise("meta")


def inventory(files: DataFrame) -> DataFrame:
    """(project, file_group, files, bytes, in_scope, status, attention): of each group, project and all of status(...)'s rows; nulls mark totals.

    Files outside of projects have the project ''. bytes leave null sizes out,
    in_scope says whether any file is, status is the one that needs most attention,
    attention counts the files that need any.
    """
    rows = files.select(
        F.coalesce(project_of("rel_path"), F.lit("")).alias("project"), file_group("rel_path").alias("file_group"), "local_size", "in_scope",
        attention_rank("status").alias("_rank"), needs_attention("status").alias("_needs"),
    )
    found = rows.rollup("project", "file_group").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("local_size"), F.lit(0)).alias("bytes"), F.coalesce(F.bool_or("in_scope"), F.lit(False)).alias("in_scope"),
        F.min("_rank").alias("_rank"), F.count_if("_needs").alias("attention"),
    )
    return found.withColumn("status", F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.col("_rank").cast("int"))).drop("_rank")


def missing_artifacts(files: DataFrame) -> DataFrame:
    """(project, missing): of each project the expected parts that no file of files (rel_path) is, in order; audio is any recording in its folder audio."""
    project, name = project_of("rel_path"), F.regexp_replace("rel_path", "^projects/[^/]+/", "")
    rows = files.where(project.isNotNull()).select(project.alias("project"), name.alias("_name"))
    has = [F.bool_or(F.col("_name").rlike(r"^audio/[^/]+$") & (F.col("_name") != "audio/audio.sha256")).alias("audio"), *[F.bool_or(F.col("_name") == n).alias(a) for a, n in ARTIFACTS]]
    found = rows.groupBy("project").agg(*has)
    return found.select("project", F.array_compact(F.array(*[F.when(~F.col(a), F.lit(a)) for a in ("audio", *(a for a, _ in ARTIFACTS))])).alias("missing"))


def unique_names(wanted: DataFrame, taken: DataFrame, stem: str = "stem", name: str = "name", most: int = 999) -> DataFrame:
    """wanted with name: the stem if free, else the first free of stem_2 to stem_<most>; null if there is none.

    wanted: stem and id, one row per pair of them; rows with the same stem get names
    in the order of id. taken: name. Only names that could collide travel: those of
    the form of a wanted stem. A stem has at most most names, so only the first most
    rows of it are ranked (each task keeps no more), and the others have none.
    """
    from pyspark.sql import Window

    stems = wanted.select(stem).distinct()
    number = F.regexp_extract(name, r"^(.*)_([1-9][0-9]{0,3})$", 2)
    base = taken.select(F.col(name).alias(stem), F.lit(1).alias("_n"))
    base = base.unionByName(taken.where(number != "").select(F.regexp_extract(name, r"^(.*)_([1-9][0-9]{0,3})$", 1).alias(stem), number.cast("int").alias("_n")))
    used = base.where(F.col("_n").between(1, most)).distinct().join(stems, stem, "left_semi").groupBy(stem).agg(F.collect_set("_n").alias("_used"))
    free = F.array_sort(F.array_except(F.sequence(F.lit(1), F.lit(most)), F.coalesce("_used", F.array().cast("array<int>"))))
    order = F.row_number().over(Window.partitionBy(stem).orderBy("id"))
    rows = wanted.select(stem, "id").withColumn("_k", order).where(F.col("_k") <= most).join(used, stem, "left").withColumn("_free", free)
    n = F.get("_free", F.col("_k") - 1)
    named = rows.select(stem, "id", F.when(n == 1, F.col(stem)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"))).alias(name))
    return salted_join(wanted, named, [stem, "id"], "id")
