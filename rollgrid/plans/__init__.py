"""rollgrid.plans"""
