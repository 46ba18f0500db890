"""Warnings of a parser of executables, normalised to a fixed vocabulary, so that numbers in them do not count."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The known warnings in the order of their index in the vector. Dots stand for what varies, before
# or after the part that is known.
WARNINGS = [
    "AddressOfEntryPoint lies outside the sections' boundaries...",
    "Bad RVA in relocation data...",
    "Byte 0x...",
    "Corrupt header...",
    "Damaged Import Table information...",
    "Don't know how to parse LOAD_CONFIG information for non-PE32...",
    "Error, too many imported symbols...",
    "Error parsing a resource directory data entry...",
    "Error parsing export directory at RVA...",
    "Error parsing resource of type RT_STRING at...",
    "Error parsing StringFileInfo/VarFileInfo struct...",
    "Error parsing the Delay import directory...",
    "Error parsing the Delay import directory at RVA...",
    "Error parsing the import directory at RVA...",
    "Error parsing the import directory. Invalid Import data at RVA...",
    "Error parsing the import table. Entries go beyond bounds...",
    "Error parsing the import table. AddressOfData overlaps with THUNK_DATA for THUNK at RVA...",
    "Error parsing the import table. Invalid data at RVA...",
    "Error parsing the resources directory. Excessively nested table depth...",
    "Error parsing the resources directory. The directory contains...",
    "Error parsing the resources directory. The file contains at least...",
    "Error parsing the resources directory. Entry...",
    "Error parsing the resources directory, attempting to read entry name. Entry names overlap...",
    "Error parsing the resources directory, attempting to read entry name. Can't read unicode string at offset...",
    "Error parsing the version information, attempting to read OffsetToData with RVA...",
    "Error parsing the version information, attempting to read VS_VERSION_INFO string...",
    "Error parsing the version information, attempting to read VarFileInfo Var string...",
    "Error parsing the version information, attempting to read StringFileInfo string...",
    "Error parsing the version information, attempting to read StringTable string...",
    "Error parsing the version information, attempting to read StringTable Key string...",
    "Error parsing the version information, to read StringTable Value string...",
    "Excessive number of imports...",
    "Export directory contains more than 10 repeated entries...",
    "Failed parsing FunctionEntry of UNWIND_INFO at...",
    "Failed rendering pascal string, attempting to read from RVA 0x...",
    "Failed rendering unicode string, attempting to read from RVA 0x...",
    "Failed to process directory...",
    "FunctionEntry of UNWIND_INFO at...",
    "If SectionAlignment...",
    "If FileAlignment > 0x200 it should be a power of 2. Value...",
    "Imported symbols contain entries typical of packed executables...",
    "Invalid bdd dynamic relocation...",
    "Invalid bdd info...",
    "Invalid debug information...",
    "Invalid function override header...",
    "Invalid function override info...",
    "Invalid IMAGE_DYNAMIC_RELOCATION_TABLE information...",
    "Invalid LOAD_CONFIG information...",
    "Invalid relocation information. Can't read...",
    "Invalid relocation information. SizeOfBlock too large...",
    "Invalid relocation information. VirtualAddress outside...",
    "Invalid resources directory. Can't read...",
    "Invalid resources directory. Can't parse directory data at RVA...",
    "Invalid TLS information. Can't read...",
    "Invalid type 0x...",
    "Invalid VS_VERSION_INFO block...",
    "No parsing available for IMAGE_DYNAMIC_RELOCATION_TABLE...",
    "Overlapping offsets in relocation data...",
    "Possibly corrupt file. AddressOfEntryPoint lies outside the file...",
    "Relocating image but PE does not have (or pefile cannot parse) a DIRECTORY_ENTRY_BASERELOC...",
    "Resource size...",
    "Rich Header is malformed...",
    "Rich Header is not in Microsoft format, possibly malformed...",
    "RVA AddressOfFunctions in the export directory points to an invalid...",
    "RVA AddressOfNames in the export directory points to an invalid...",
    "RVA of IMAGE_BOUND_IMPORT_DESCRIPTOR points...",
    "SizeOfHeaders is smaller than AddressOfEntryPoint...",
    "Suspicious flags set for section...",
    "Suspicious NumberOfRvaAndSizes in the Optional Header...",
    "Suspicious value found parsing section...",
    "The Bound Imports directory exists but can't be parsed...",
    "Too many warnings parsing section. Aborting...",
    "Too many errors parsing the Delay import directory...",
    "Too many errors parsing the import directory...",
    "Too many sections...",
    "Unknown UNWIND_CODE at...",
    "Unsupported version of UNWIND_INFO...",
    "...Contents are null-bytes.",
    "...No data in the file (is this corkami's virtsectblXP?).",
    "...PointerToRawData points beyond the end of the file.",
    "...PointerToRawData should normally be a multiple of FileAlignment, this might imply the file is trying to confuse tools which parse this incorrectly.",
    "...SizeOfRawData is larger than file.",
    "...VirtualSize is extremely large > 256MiB",
    "...VirtualAddress is beyond 0x10000000",
    "...symbol entries. Assuming corrupt.",
    "...ordinal entries. Assuming corrupt.",
    "...Assuming corrupt.",
]
DOTS = "..."
# Of several known parts that fit, the longest says most.
ENDINGS = sorted((w.removeprefix(DOTS) for w in WARNINGS if w.startswith(DOTS)), key=len, reverse=True)
BEGINNINGS = sorted((w.removesuffix(DOTS) for w in WARNINGS if not w.startswith(DOTS)), key=len, reverse=True)


def known(warning: str) -> str | None:
    """The vocabulary's form of a warning: by its ending if that is known, else by its beginning."""
    for part in ENDINGS:
        if warning.endswith(part):
            return DOTS + part
    for part in BEGINNINGS:
        if warning.startswith(part):
            return part + DOTS
    return None


def flags_of_forms(forms: Iterable[str]) -> list[float]:
    """One flag for each known form among forms that are brought to the vocabulary already, then how many entries there are,
    known or not."""
    entries = list(forms)
    found = set(entries)
    return [*(float(w in found) for w in WARNINGS), float(len(entries))]


def flags(warnings: Iterable[str]) -> list[float]:
    """The same of raw warnings: the distinct forms of those that are known."""
    return flags_of_forms(sorted({known(w) for w in warnings} - {None}))


def normalised(warning: Column) -> Column:
    """The known form as an expression over a column; null for unknown warnings."""
    by_end = [F.when(F.endswith(warning, F.lit(p)), F.lit(DOTS + p)) for p in ENDINGS]
    by_start = [F.when(F.startswith(warning, F.lit(p)), F.lit(p + DOTS)) for p in BEGINNINGS]
    return F.coalesce(*by_end, *by_start)
