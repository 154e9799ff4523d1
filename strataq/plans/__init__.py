"""strataq.plans"""
