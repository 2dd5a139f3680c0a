"""rollgrid.streaming"""
