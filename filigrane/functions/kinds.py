"""File types, categories and folder names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigrane.functions.text import extension

# Extensions of each type.
TYPES = {
    "video": "mp4 avi mkv mov wmv flv webm m4v mpg mpeg",
    "image": "jpg jpeg png gif bmp svg webp ico tiff tif",
    "document": "pdf doc docx txt rtf odt tex",
    "spreadsheet": "xls xlsx csv ods",
    "presentation": "ppt pptx odp key",
    "audio": "mp3 wav flac aac ogg wma m4a opus",
    "archive": "zip rar 7z tar gz bz2 xz",
    "code": "cs js py java cpp c h html css json xml",
    "executable": "exe dll msi bat cmd sh",
    "text": "txt md log cfg ini conf",
}
# What the categories are made of.
CATEGORIES = {
    "document": ("document spreadsheet presentation text", ""),
    "image": ("image", "heic"),
    "video": ("video", ""),
    "audio": ("audio", ""),
    "archive": ("archive", ""),
    "code": ("code", "sql ts php xaml ps1 htm yml yaml"),
    "application": ("executable", ""),
}
# Names of well-known folders.
FOLDER_NAMES = (
    ("downloads", "indirilenler", "download"),
    ("desktop", "masaüstü", "masa üstü"),
    ("documents", "belgeler", "dökümanlar", "dokümanlar"),
    ("pictures", "resimler", "fotograflar", "fotoğraflar"),
    ("music", "müzik", "muzik"),
    ("videos", "videolar", "video"),
)
# What a watcher leaves out.
EXCLUDED_PARTS = ("$Recycle.Bin", "System Volume Information", ".git", "node_modules", "bin", "obj", "__pycache__")
EXCLUDED_EXTENSIONS = (".tmp", ".temp", ".partial", ".crdownload")


def type_extensions(name: str) -> list[str]:
    """Extensions with dots of a type; an unknown type is an extension itself."""
    known = TYPES.get(name.lower())
    return [f".{x}" for x in known.split()] if known else [f".{name.lower().lstrip('.')}"]


def category_extensions(name: str) -> list[str]:
    kinds, more = CATEGORIES[name]
    return sorted({e for k in kinds.split() for e in type_extensions(k)} | {f".{x}" for x in more.split()})


def in_categories(name: Column, categories) -> Column:
    own = sorted({e for c in categories for e in category_extensions(c)})
    return F.lower(extension(name)).isin(own) if own else F.lit(False)


def toggled(categories: frozenset, category: str) -> frozenset:
    return frozenset(categories) ^ {category}


def folder_synonyms(name: str) -> list[str]:
    for group in FOLDER_NAMES:
        if name.lower() in group[:2]:
            return list(group)
    return [name.lower()]


def excluded(path: Column, separator: str = "\\") -> Column:
    parts = [F.contains(F.lower(path), F.lit(f"{separator}{p}{separator}".lower())) for p in EXCLUDED_PARTS]
    ends = [F.endswith(F.lower(path), F.lit(e)) for e in EXCLUDED_EXTENSIONS]
    out = F.lit(False)
    for p in [*parts, *ends]:
        out = out | p
    return out
