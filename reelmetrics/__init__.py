"""Analytics over what video-processing jobs leave behind, as Spark DataFrames."""

from reelmetrics.settings import Settings

__all__ = ["Settings"]
