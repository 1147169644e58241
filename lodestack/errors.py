"""What can be wrong with a catalogue."""


class CatalogueError(Exception):
    """Any failure to open or change a catalogue."""


class CatalogueInUse(CatalogueError):
    """Another writer published first."""


class InvalidCatalogue(CatalogueError):
    """The folder holds no catalogue, or a damaged one."""


class UnsupportedCatalogue(CatalogueError):
    """The catalogue is newer than this package."""
