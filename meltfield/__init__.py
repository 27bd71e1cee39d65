"""meltfield: a PySpark-native engine for lack-of-fusion porosity in laser powder-bed-fusion builds."""

__version__ = "0.1.0"
