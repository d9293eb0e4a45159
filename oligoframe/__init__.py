"""Design and validation of DNA barcode libraries as Spark plans."""

from .config import Filter
from .plans.generate import Library, generate
from .plans.validate import ValidationResult, validate

__version__ = "0.1.0"
__all__ = ["Filter", "Library", "ValidationResult", "generate", "validate"]
