"""Tables written between jobs; see ``daftar.stages``."""

from daftar.stages import Scratch, settings, shared_dir

__all__ = ["Scratch", "settings", "shared_dir"]
