"""Market-data transforms and data-preparation operators on PySpark DataFrames."""

from tickloom.config import Config, column_names
from tickloom.operators.bars import bar_groups, dollar_bars, tick_bars, time_bars, volume_bars

__version__ = "0.1.0"
__all__ = ["Config", "__version__", "bar_groups", "column_names", "dollar_bars", "tick_bars", "time_bars", "volume_bars"]
