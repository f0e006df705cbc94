"""Rule tables: fixed values of the domain, each as text in its natural order, and as DataFrames to join with.

Every table has far fewer than a thousand rows, whatever the size of the data, so joins broadcast it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Reference ranges as key, low, high and, where it depends on it, sex. Order decides without a sex.
RANGES = """
rbc 4500000 5850000 M
rbc 4080000 5200000 F
hemoglobin 13.5 17.5 M
hemoglobin 12 16 F
hematocrit 40 52 M
hematocrit 37 47 F
mcv 80 100
mch 27 33
mchc 32 36
rdw 11.5 14.5
wbc 4000 10000
neut_pct 42 65
lymph_pct 17 45
mono_pct 2 10
eos_pct 1 4
baso_pct 0 2
neut_abs 2000 7000
lymph_abs 800 4000
mono_abs 200 900
eos_abs 20 500
baso_abs 0 200
platelets 150000 450000
mpv 6.2 11.8
esr 0 20
glucose 70 100
hba1c 4 5.6
urea 10 50
creatinine 0.7 1.2
uric_acid 3.5 7
cholesterol 0 200
hdl 40 100 M
hdl 50 100 F
ldl 0 100
vldl 0 40
trig 0 150
lipids_total 400 800
got 0 37
gpt 0 42
alp 0 120
bili_t 0 1.1
bili_d 0 0.25
bili_i 0 0.85
total_protein 6.1 7.9
albumin 3.5 4.8
calcium 8.5 10.5
phosphorus 2.5 4.5
magnesium 1.7 2.4
sodium 135 145
potassium 3.5 5.1
chloride 98 107
amylase 0 120
ck 0 170 M
ck 0 145 F
ck_mb 0 5
ldh 0 250
crp 0 6
psa_total 0 3.1
psa_free 0 2.5
troponin 0 0.03
tsh 0.27 4.2
t4_total 5.1 14.1
t4_free 0.8 1.8
t3_total 80 200
t3_free 2 4.4
vit_d 30 100
ferritin 20 300
"""

# Key, and the limits above and below which a value is critical.
CRITICAL = """
potassium 5.5 3
sodium 150 125
glucose 250 45
calcium 12 7
troponin 0.05 -
platelets - 50000
wbc 30000 1000
crp 10 -
creatinine 3 -
bili_t 5 -
psa_total 10 -
"""

# Key, and between what a limit printed on a report is believed.
PLAUSIBLE = """
glucose 30 600
hba1c 2 20
urea 3 300
creatinine 0.1 20
uric_acid 1 15
cholesterol 50 600
hdl 10 150
ldl 10 400
vldl 1 200
trig 10 2000
lipids_total 100 2000
got 2 1000
gpt 2 1000
alp 10 1000
bili_t 0.01 30
bili_d 0 10
bili_i 0 20
total_protein 3 12
albumin 1 8
calcium 4 16
phosphorus 0.5 10
magnesium 0.5 6
sodium 100 180
potassium 1 9
chloride 70 140
amylase 10 2000
ck 10 50000
ck_mb 0 100
ldh 50 3000
crp 0 300
psa_total 0 100
psa_free 0 20
troponin 0 10
tsh 0.001 100
t4_total 0.5 30
t3_total 10 500
vit_d 1 200
ferritin 1 5000
esr 0 200
rbc 1000000 9000000
hemoglobin 3 25
hematocrit 10 70
mcv 50 140
mch 15 45
mchc 20 45
rdw 5 30
wbc 200 50000
neut_pct 5 95
lymph_pct 5 95
mono_pct 0 30
eos_pct 0 30
baso_pct 0 10
neut_abs 100 20000
lymph_abs 100 15000
mono_abs 10 5000
eos_abs 0 3000
baso_abs 0 1000
platelets 10000 1000000
mpv 3 20
"""

# Unit and the keys that are measured in it.
UNITS = """
/µL: rbc wbc neut_abs lymph_abs mono_abs eos_abs baso_abs platelets
g/dL: hemoglobin mchc total_protein albumin
%: hematocrit rdw neut_pct lymph_pct mono_pct eos_pct baso_pct hba1c
fL: mcv mpv
pg: mch
mm/h: esr
mg/dL: glucose urea creatinine uric_acid cholesterol hdl ldl vldl trig lipids_total phospholipids bili_t bili_d bili_i calcium phosphorus magnesium
U/L: got gpt alp ldh amylase ck
mEq/L: sodium potassium chloride
ng/mL: ck_mb psa_total psa_free troponin vit_d ferritin
mg/L: crp
µUI/mL: tsh
µg/dL: t4_total
ng/dL: t4_free t3_total
pg/mL: t3_free
"""

# Category and its keys.
CATEGORIES = """
hemogram: rbc hemoglobin hematocrit mcv mch mchc rdw wbc neut_pct lymph_pct mono_pct eos_pct baso_pct neut_abs lymph_abs mono_abs eos_abs baso_abs platelets mpv esr
metabolic: glucose hba1c hba1c_ifcc calcium phosphorus vit_d ferritin
renal: urea creatinine uric_acid uric
lipids: cholesterol hdl ldl vldl trig lipids_total phospholipids
hepatic: got gpt alp bili_t bili_d bili_i total_protein albumin ldh
electrolytes: magnesium sodium potassium chloride
pancreatic: amylase
cardiac: ck ck_mb troponin
inflammation: crp
tumor: psa_total psa_free
thyroid: tsh t4_total t4_free t3_total t3_free
blood_type: blood_group rh
respiratory: influenza_a influenza_b rsv adenovirus mycoplasma
"""

# Key and the normalised names that mean it.
SYNONYMS = """
rbc: globulos rojos, globulos rojos rbc, eritrocitos
hemoglobin: hemoglobina, hemoglobina hb
hematocrit: hematocrito, hematocrito hto
mcv: mcv, mcv volumen corpuscular medio, vcm, v c m
mch: mch, mch hemoglobina corpuscular media, hcm, h c m
mchc: mchc, mchc conc de hg corpuscular media, chcm, c h c m
rdw: rdw, rdw cv, ade
wbc: globulos blancos, globulos blancos wbc, leucocitos
neut_pct: neutrofilos, neutrofilos segmentados, neutrofilos segmentados %, neutrofilos %
lymph_pct: linfocitos
mono_pct: monocitos
eos_pct: eosinofilos
baso_pct: basofilos
neut_abs: neutrofilos segmentados abs, neutrofilos absolutos
lymph_abs: linfocitos abs, linfocitos absolutos
mono_abs: monocitos abs
eos_abs: eosinofilos abs
baso_abs: basofilos abs
platelets: plaquetas, plaquetas plt
mpv: mpv
esr: eritrosedimentacion, eritrosedimentacion vsg
glucose: glucosa, glicemia, glicemia sangre
hba1c: hemoglobina glicada, hemoglobina glicosilada, hemoglobina glicada hba1c, hba1c, hemoglobina glicada al c, hemoglobina glicada a1c, al c ngsp
hba1c_ifcc: al c ifcc
urea: urea, urea en sangre, uremia
creatinine: creatinina, creatinina en suero, creatinina sangre
uric_acid: acido urico, acidourico, acido urico sangre
cholesterol: colesterol total, colesterol total sangre, colestrol total
hdl: colesterol hdl, colesterol hdl sangre, colestrol hdl
ldl: colesterol ldl, colesterol ldl sangre, colestrol ldl
vldl: colesterol vldl, colesterol vldl sangre, colestrol vldl
trig: trigliceridos, trigliceridos sangre, trigliceridos sanguineos
lipids_total: lipidos totales
phospholipids: fosfolipidos
got: got ast, got, asat got, got ast sangre
gpt: gpt alt, gpt, alat gpt, gpt alt sangre
alp: fosfatasa alcalina
bili_t: bilirrubina total
bili_d: bilirrubina directa, bilirrubina d
bili_i: bilirrubina indirecta, bilirrubina i
total_protein: proteinas totales
albumin: albumina
calcium: calcio, calcio total sangre
phosphorus: fosforo, fosforo sangre
magnesium: magnesio
sodium: sodio
potassium: potasio
chloride: cloro, cloruro
amylase: amilasa
ck: ck total, ck total sangre
ck_mb: ck mb, ck mb sangre
ldh: ldh, ldh sangre
crp: proteina c reactiva, proteina c reactiva pcr, pcr
psa_total: psa total
psa_free: psa libre
troponin: troponina i ultrasensible cuantitativa sangre, troponina i, troponina i ultrasensible
tsh: tsh, tsh tirotropina, tsh 3ra generacion
t4_total: t4 total
t4_free: t4 libre
t3_total: t3 total
t3_free: t3 libre
blood_group: grupo
rh: factor rh
influenza_a: influenza a antigeno, ag influenza a
influenza_b: influenza b antigeno, ag influenza b
rsv: ag virus sincitial respiratorio
adenovirus: ag adenovirus
mycoplasma: ag mycoplasma pneumoniae
vit_d: vitamina d, vitamina d 25 oh, 25 oh vitamina d
ferritin: ferritina
"""

# Names that mean an absolute count where the unit or section says so, in order of precedence.
ABSOLUTE = """
neut_abs: neutrofilos segmentados
neut_abs: neutrofilos
lymph_abs: linfocitos
mono_abs: monocitos
eos_abs: eosinofilos
baso_abs: basofilos
"""

# Body system and its keys.
SYSTEMS = """
metabolic: glucose hba1c
cardiovascular: cholesterol ldl hdl trig
renal: creatinine urea uric_acid
hepatic: got gpt alp bili_t
thyroid: tsh t4_total t3_total
haematology: hemoglobin hematocrit wbc platelets
inflammation: crp esr
electrolytes: potassium sodium calcium magnesium
"""

# Statistic that a finding of these keys is explained by.
STATISTICS = """
diabetes_risk: glucose hba1c
ldl_high: ldl
hdl_low: hdl
trig_high: trig
renal_risk: creatinine urea
fatty_liver_risk: got gpt alp
anemia_risk: hemoglobin
gout_risk: uric_acid
thyroid_risk: tsh t4_total t3_total
psa_risk: psa_total
inflammation_risk: crp
troponin_risk: troponin
hyperkalemia_risk: potassium
thrombocytopenia_risk: platelets
"""

# Medicine, its name, its effects (test, direction, severity) and interactions (other, severity).
DRUGS = """
metformina | Metformina | glucose down green, b12 down yellow, creatinine up yellow | diureticos yellow, contraste red, alcohol red
glibenclamida | Glibenclamida (sulfonilurea) | glucose down green | alcohol yellow
insulina | Insulina | glucose down green, potassium down yellow | 
atorvastatina | Atorvastatina (estatina) | cholesterol down green, ldl down green, got up yellow, gpt up yellow, ck up red | fibratos red, warfarin yellow, eritromicina yellow
simvastatina | Simvastatina (estatina) | cholesterol down green, ldl down green, got up yellow, gpt up yellow, ck up red | fibratos red, warfarin yellow
enalapril | Enalapril (IECA) | potassium up yellow, creatinine up yellow | diureticos ahorradores red, aines yellow, suplementos potasio yellow
losartan | Losartán (ARA-II) | potassium up yellow, creatinine up yellow | diureticos ahorradores red, aines yellow
hidroclorotiazida | Hidroclorotiazida (diurético tiazídico) | potassium down yellow, sodium down yellow, uric_acid up yellow, glucose up yellow, calcium up yellow, cholesterol up yellow | digoxina red, litio yellow
furosemida | Furosemida (diurético de asa) | potassium down yellow, sodium down yellow, uric_acid up yellow, creatinine up yellow, calcium down yellow | digoxina red, aines yellow
aspirina | Aspirina (ácido acetilsalicílico) | uric_acid down green, platelets down yellow, creatinine up yellow | warfarin red, aines yellow, metotrexato red
clopidogrel | Clopidogrel |  | omeprazol yellow, warfarin yellow
warfarin | Warfarina (anticoagulante) | inr up red | aspirina red, aines red, antibioticos yellow, amiodarona red
levotiroxina | Levotiroxina (hormona tiroidea) | tsh down yellow, t4_total up green | calcio yellow, hierro yellow, omeprazol yellow
amiodarona | Amiodarona | tsh up yellow, got up yellow, gpt up yellow | warfarin red, digoxina red, estatinas yellow
omeprazol | Omeprazol (inhibidor de bomba) | magnesium down yellow, b12 down yellow | clopidogrel yellow, levotiroxina yellow
vitamina b12 | Vitamina B12 | b12 up green | 
vitamina d | Vitamina D (colecalciferol) | vit_d up green, calcium up yellow | 
calcio | Calcio (suplemento) | calcium up yellow | levotiroxina yellow
hierro | Hierro (suplemento) | ferritin up green | levotiroxina yellow
alopurinol | Alopurinol | uric_acid down green | azatioprina red
paracetamol | Paracetamol (acetaminofén) | got up yellow, gpt up yellow | warfarin yellow
ibuprofeno | Ibuprofeno (AINE) | creatinine up yellow, potassium up yellow, sodium up yellow | enalapril yellow, losartan yellow, aspirina yellow, furosemida yellow, warfarin red
sildenafil | Sildenafil |  | nitratos red
prednisona | Prednisona (corticoide) | glucose up yellow, potassium down yellow, sodium up yellow, wbc up yellow | aines red, diureticos yellow
salbutamol | Salbutamol (broncodilatador) | potassium down yellow, glucose up yellow | 
biotina | Biotina (vitamina B7, suplemento) | tsh interferes red, troponin interferes red | 
anticonceptivos | Anticonceptivos orales | trig up yellow, glucose up yellow, tsh up yellow | 
sertralina | Sertralina (ISRS) | sodium down yellow | aines yellow, aspirina yellow
tamsulosina | Tamsulosina (alfabloqueante) |  | 
finasterida | Finasterida | psa_total down yellow | 
rosuvastatina | Rosuvastatina (estatina) | cholesterol down green, ldl down green, got up yellow, gpt up yellow, ck up red | fibratos red
amlodipino | Amlodipino (bloqueante cálcico) |  | simvastatina yellow
espirolactona | Espironolactona (diurético ahorrador de K) | potassium up red, creatinine up yellow | enalapril red, losartan red, suplementos potasio red
digoxina | Digoxina | potassium down yellow, creatinine up yellow | furosemida red, hidroclorotiazida red, amiodarona red
"""

# Names under which a medicine is entered, in order of precedence; alone where it is the key.
ALIASES = """
metformin: metformina
metformina
glibenclamida
glinbenclamida: glibenclamida
insulina
insulina glargina: insulina
atorvastatina
atorvastatin: atorvastatina
simvastatina
simvastatin: simvastatina
rosuvastatina
rosuvastatin: rosuvastatina
enalapril
enalaprilo: enalapril
losartan
losartán: losartan
losartan potasico: losartan
hidroclorotiazida
hidroclorotiazide: hidroclorotiazida
hctz: hidroclorotiazida
furosemida
furosemide: furosemida
aspirina
aspirin: aspirina
aas: aspirina
clopidogrel
warfarin
warfarina: warfarin
coumadin: warfarin
levotiroxina
levothyroxine: levotiroxina
eutirox: levotiroxina
amiodarona
amiodarone: amiodarona
omeprazol
omeprazole: omeprazol
vitamina b12
b12: vitamina b12
cianocobalamina: vitamina b12
vitamina d
colecalciferol: vitamina d
calcio
calcium: calcio
hierro
hierro sulfato: hierro
iron: hierro
alopurinol
allopurinol: alopurinol
paracetamol
acetaminofen: paracetamol
acetaminofén: paracetamol
ibuprofeno
ibuprofen: ibuprofeno
sildenafil
viagra: sildenafil
prednisona
prednisone: prednisona
salbutamol
biotina
biotin: biotina
anticonceptivos
anticonceptivo: anticonceptivos
anovulatorios: anticonceptivos
sertralina
sertraline: sertralina
tamsulosina
finasterida
finasteride: finasterida
amlodipino
amlodipine: amlodipino
espirolactona
espironolactona: espirolactona
spironolactone: espirolactona
digoxina
digoxin: digoxina
"""

def _number(x: str) -> float | None:
    return None if x == "-" else float(x)


def _lists(text: str, by: str = " ") -> list[tuple[str, str]]:
    """(name, member) for every member of every line ``name: member member``."""
    rows = (line.split(": ") for line in text.strip().splitlines())
    return [(name, member.strip()) for name, members in rows for member in members.split(by)]


def _rows(text: str) -> list[list[str]]:
    return [line.split() for line in text.strip().splitlines()]


def ranges(spark: SparkSession) -> DataFrame:
    rows = [(r[0], i, float(r[1]), float(r[2]), r[3] if len(r) > 3 else None) for i, r in enumerate(_rows(RANGES))]
    return spark.createDataFrame(rows, "key string, ord int, lo double, hi double, sex string")


def critical(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, _number(h), _number(low)) for k, h, low in _rows(CRITICAL)], "key string, critical_high double, critical_low double")


def plausible(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(a), float(b)) for k, a, b in _rows(PLAUSIBLE)], "key string, least double, most double")


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, u) for u, k in _lists(UNITS)], "key string, std_unit string")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c) for c, k in _lists(CATEGORIES)], "key string, category string")


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, key) for i, (key, name) in enumerate(_lists(SYNONYMS, ","))], "ord int, synonym string, key string")


def absolute_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, key) for i, (key, name) in enumerate(_lists(ABSOLUTE, ","))], "ord int, synonym string, key string")


def systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, k) for i, (s, k) in enumerate(_lists(SYSTEMS))], "ord int, system string, key string")


def statistics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s) for s, k in _lists(STATISTICS)], "key string, statistic string")


def aliases(spark: SparkSession) -> DataFrame:
    rows = [(line.split(": ") * 2)[:2] for line in ALIASES.strip().splitlines()]
    return spark.createDataFrame([(i, a, k) for i, (a, k) in enumerate(rows)], "ord int, alias string, drug string")


def _drug_parts() -> list[list[str]]:
    return [[x.strip() for x in line.split("|")] for line in DRUGS.strip().splitlines()]


def drugs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n) for k, n, _, _ in _drug_parts()], "drug string, drug_name string")


def lab_effects(spark: SparkSession) -> DataFrame:
    rows = [(k, i, *e.split()) for k, _, effects, _ in _drug_parts() for i, e in enumerate(filter(None, effects.split(", ")))]
    return spark.createDataFrame(rows, "drug string, ord int, test string, direction string, severity string")


def interactions(spark: SparkSession) -> DataFrame:
    rows = [(k, i, *o.rsplit(" ", 1)) for k, _, _, others in _drug_parts() for i, o in enumerate(filter(None, others.split(", ")))]
    return spark.createDataFrame(rows, "drug string, ord int, other string, severity string")


def standard_range_texts(spark: SparkSession) -> DataFrame:
    """key and how its reference range reads: worded phrases where there are such, else its limits and unit."""
    from serieslab.functions.numbers import short_number

    low, high = short_number(F.col("lo")), short_number(F.col("hi"))
    limits = F.when(F.col("lo") == 0, F.concat(F.lit("inferior a "), high)).otherwise(F.concat(F.lit("entre "), low, F.lit(" y "), high))
    sex = F.when(F.col("sex") == "M", " (hombre)").when(F.col("sex") == "F", " (mujer)").otherwise("")
    one = F.concat(limits, F.coalesce(F.concat(F.lit(" "), F.col("std_unit")), F.lit("")), sex)
    listed = ranges(spark).join(units(spark), "key", "left").select("key", "ord", one.alias("text"))
    listed = listed.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " · ").alias("limits"))
    phrases = spark.createDataFrame([line.split(": ", 1) for line in PHRASES.strip().splitlines()], "key string, phrase string")
    return listed.join(phrases, "key", "full").select("key", F.coalesce("phrase", "limits").alias("range_text"))


# Reference ranges that are worded otherwise than from their limits.
PHRASES = """
cholesterol: deseable inferior a 200 mg/dL
ldl: deseable inferior a 100 mg/dL
hdl: superior a 40 mg/dL (hombre) / 50 mg/dL (mujer)
trig: inferior a 150 mg/dL
hba1c: 4,0 – 5,6 %
glucose: 70 – 100 mg/dL en ayunas
rbc: 4.500.000 – 5.850.000 /µL (hombre) · 4.080.000 – 5.200.000 /µL (mujer)
hemoglobin: 13,5 – 17,5 g/dL (hombre) · 12,0 – 16,0 g/dL (mujer)
hematocrit: 40 – 52 % (hombre) · 37 – 47 % (mujer)
wbc: 4.000 – 10.000 /µL
platelets: 150.000 – 450.000 /µL
"""
