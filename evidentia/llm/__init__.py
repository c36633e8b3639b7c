"""Training-data pipeline operators: ten independent components over document tables."""
