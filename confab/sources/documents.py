"""Document files written as a Spark data source with commit: ``df.write.format("meeting_documents")``.

Rows are (``name``, ``parts``): a file name and the pieces of the document.  Every task attempt
writes into a folder of its own, then a list of its files, and only then moves them to their
places, so a task that is run again leaves one file a name.  The manifest, written when all tasks
are done, says which lists count; it is the only record of what exists.  When the job fails all
that its tasks have put in place is deleted.  Nothing but counts goes through the driver.

Options: ``path`` (URI of a folder that workers reach) and ``kind`` (docx or pdf).  Names are
replaced if they exist.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "meeting_documents"
LISTED = "name string, bytes long, sha256 string"


@dataclass
class Done(WriterCommitMessage):
    attempt: str
    files: int


def _put(system, name: str, data: bytes) -> None:
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name) as f:
        f.write(data)


class DocumentWriter(DataSourceWriter):
    def __init__(self, uri: str, kind: str):
        self.uri, self.kind, self.job = uri, kind, uuid.uuid4().hex

    def _places(self):
        """(file system, folder, this job's attempts, this job's lists)."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.uri)
        return system, root, f"{root}/_attempts/{self.job}", f"{root}/_manifests/{self.job}"

    def write(self, iterator: Iterator) -> Done:
        from pyspark import TaskContext

        from confab.sources.sinks import docx_bytes, pdf_bytes

        make, t = {"docx": docx_bytes, "pdf": pdf_bytes}[self.kind], TaskContext.get()
        (system, root, attempts, lists), attempt, listed = self._places(), f"{t.partitionId():06d}-{t.taskAttemptId()}", []
        for row in iterator:
            data = make(row["parts"])
            _put(system, f"{attempts}/{attempt}/{row['name']}", data)
            listed.append({"name": row["name"], "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        if listed:
            _put(system, f"{lists}/{attempt}.json", "\n".join(map(json.dumps, listed)).encode())
            for x in listed:
                system.move(f"{attempts}/{attempt}/{x['name']}", f"{root}/{x['name']}")
        return Done(attempt, len(listed))

    def _listed(self, system, lists: str) -> list:
        from pyarrow import fs

        return system.get_file_info(fs.FileSelector(lists, allow_not_found=True))

    def _clear(self, system, folder: str) -> None:
        from pyarrow import fs

        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)

    def commit(self, messages: list[Done | None]) -> None:
        system, root, attempts, lists = self._places()
        good = {m.attempt for m in messages if m and m.files}
        for info in self._listed(system, lists):
            if info.base_name.removesuffix(".json") not in good:
                system.delete_file(info.path)
        _put(system, f"{root}/_manifests/{self.job}.json", json.dumps({"lists": sorted(good), "files": sum(m.files for m in messages if m)}).encode())
        self._clear(system, attempts)

    def abort(self, messages: list[Done | None]) -> None:
        from pyarrow import fs

        system, root, attempts, lists = self._places()
        for info in self._listed(system, lists):
            with system.open_input_stream(info.path) as f:
                names = [json.loads(x)["name"] for x in f.read().decode().split("\n")]
            for name in names:
                if system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                    system.delete_file(f"{root}/{name}")
        self._clear(system, lists)
        self._clear(system, attempts)


class MeetingDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTED

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if self.options.get("kind") not in ("docx", "pdf"):
            raise ValueError("the option kind must be docx or pdf")
        return DocumentWriter(self.options["path"], self.options["kind"])


def write_documents(documents: DataFrame, kind: str, directory: str) -> None:
    """Writes (``name``, ``parts``) rows as files of ``directory``; all of them, or none."""
    spark = documents.sparkSession
    spark.dataSource.register(MeetingDocuments)
    documents.select("name", "parts").write.format(FORMAT).option("kind", kind).mode("append").save(directory)


def exported(spark: SparkSession, directory: str) -> DataFrame:
    """(``job``, ``name``, ``bytes``, ``sha256``) of all files that the folder's manifests list."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(directory)
    jobs = [i.base_name for i in system.get_file_info(fs.FileSelector(f"{root}/_manifests", allow_not_found=True)) if i.type == fs.FileType.File]
    paths = []
    for name in jobs:  # an export each
        with system.open_input_stream(f"{root}/_manifests/{name}") as f:
            lists = json.loads(f.read())["lists"]
        paths += [f"{directory}/_manifests/{name.removesuffix('.json')}"] if lists else []
    if not paths:
        return spark.createDataFrame([], f"job string, {LISTED}")
    return spark.read.schema(LISTED).json(paths).select(F.regexp_extract(F.col("_metadata.file_path"), "_manifests/([^/]+)/", 1).alias("job"), "*")
