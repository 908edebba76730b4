"""Sources: recordings from GPX, FIT and zipped exports, and a synthetic library."""
