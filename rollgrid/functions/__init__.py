"""rollgrid.functions"""
