"""Rules as data: detectors, file names, stack signatures."""
