"""rollgrid.sources"""
