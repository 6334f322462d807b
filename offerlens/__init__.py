"""offerlens: price intelligence over product offers, as DataFrame operators."""

__version__ = "0.1.0"
