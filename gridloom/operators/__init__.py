"""Panel, trend, calendar, association, metric, resampling, spatial and decision operators on DataFrames."""
