"""rollgrid.operators"""
