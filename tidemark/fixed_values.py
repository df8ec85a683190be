"""Constants that must be equal everywhere for results to agree.

They are parameters' defaults; every operator takes its own override.
"""

# Series shape.
STEP_SECONDS = 1800
SAMPLES_PER_DAY = 48
SAMPLES_PER_WEEK = 336

# Known label intervals (both ends inclusive) and the window
# starts that are left out of the metrics.
LABEL_INTERVALS = [
    ("2014-11-01 19:00:00", "2014-11-03 22:30:00", "marathon"),
    ("2014-11-25 12:00:00", "2014-11-29 19:00:00", "thanksgiving"),
    ("2014-12-23 11:30:00", "2014-12-27 18:30:00", "christmas"),
    ("2014-12-29 21:30:00", "2015-01-03 04:30:00", "new year"),
    ("2015-01-24 20:30:00", "2015-01-29 03:30:00", "blizzard"),
]
EDGE_CASE_STARTS = ["2015-01-04", "2015-01-18"]
SCORING_CUTOFF = "2014-08-31"

# Localisation scales in hours, the scale that is reported, the
# error level counted inside a span and the spike multiple of the span mean.
SCALES_HOURS = [1, 2, 3, 6, 12, 24, 48]
REPORT_SCALE_HOURS = 6
SAMPLES_PER_HOUR = 2
ERROR_LEVEL = 0.2
SPIKE_MULTIPLE = 8.0

# The hand-picked trial list, one row per trial as
# (hidden_dim, num_layers, dropout, learning_rate, threshold_percentile).
FOCUSED_TRIALS = [
    (32, 1, 0.2, 1e-3, 99.99),
    (32, 1, 0.0, 1e-3, 99.99),
    (40, 1, 0.2, 1e-3, 99.99),
    (40, 1, 0.2, 5e-4, 99.99),
    (64, 1, 0.0, 1e-3, 99.99),
    (64, 1, 0.1, 1e-3, 99.99),
    (64, 1, 0.2, 1e-3, 99.99),
    (64, 1, 0.2, 5e-4, 99.99),
    (64, 1, 0.3, 5e-4, 99.99),
    (64, 2, 0.2, 5e-4, 99.99),
    (128, 1, 0.2, 5e-4, 99.99),
    (128, 1, 0.3, 5e-4, 99.99),
    (64, 1, 0.2, 5e-4, 99.0),
    (64, 1, 0.2, 5e-4, 99.9),
]

# Axes of the full hyper-parameter grid.
GRID_HIDDEN = [32, 40, 64, 128]
GRID_LAYERS = [1, 2]
GRID_DROPOUT = [0.0, 0.1, 0.2, 0.3]
GRID_RATE = [1e-4, 5e-4, 1e-3]
GRID_PERCENTILE = [90.0, 95.0, 99.0]

# Ranges of the random search.
RANDOM_HIDDEN = (16, 128)
RANDOM_LAYERS = (1, 3)
RANDOM_DROPOUT = (0.0, 0.4)
RANDOM_RATE_EXPONENT = (-4.0, -2.0)
RANDOM_PERCENTILE = (85.0, 99.0)
