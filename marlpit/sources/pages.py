"""Pages of files as rows, by parsers in Python. What a parser raises is a row with its error."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator, Mapping
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.functions.text import extension

#: Bytes of a file to the texts of its pages.
Parser = Callable[[bytes], Iterable[str | None]]
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BREAKS = {f"{WORD}br": "\n", f"{WORD}cr": "\n", f"{WORD}tab": "\t"}


def paragraph_text(paragraph: ElementTree.Element) -> str:
    return "".join(x.text or "" if x.tag == f"{WORD}t" else BREAKS.get(x.tag, "") for x in paragraph.iter())


def docx_pages(content: bytes) -> list[str]:
    """The paragraphs of a .docx file as one page, a newline between them; those in tables aren't listed."""
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        body = ElementTree.fromstring(packed.read("word/document.xml")).find(f"{WORD}body")
    return ["\n".join(map(paragraph_text, body.findall(f"{WORD}p")))] if body is not None else []


#: Parsers that the standard library is enough for.
OWN_PARSERS: dict[str, Parser] = {".docx": docx_pages}


def page_function(parsers: Mapping[str, Parser]):
    """A table function of (extension, content): a row (page, text, error) for each page, or one row with an error."""

    class Pages:
        def eval(self, kind: str, content: bytes) -> Iterator[tuple[int, str | None, str | None]]:
            page = 0
            try:
                for page, text in enumerate(parsers[kind](bytes(content)), 1):
                    yield page, text, None
            except Exception as raised:  # whatever a parser raises is said of the file; other files go on
                yield page + 1, None, f"{type(raised).__name__}: {raised}"[:500]
                return
            if not page:
                yield 1, None, f"no pages in {kind}"

    return F.udtf(Pages, returnType="page int, text string, error string")


def read_pages(files: DataFrame, parsers: Mapping[str, Parser], path: str = "path", content: str = "content") -> DataFrame:
    """(path, page, text, error) of files that there is a parser for; pages before a failure are there too."""
    own = files.select(F.col(path).alias("path"), extension(path).alias("kind"), F.col(content).alias("content")).filter(F.col("kind").isin(list(parsers)))
    return own.lateralJoin(page_function(parsers)(F.col("kind").outer(), F.col("content").outer())).select("path", "page", "text", "error")
